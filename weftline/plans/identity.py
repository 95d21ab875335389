"""Which file derives from which: joins on tensor identity, with ties refused rather than guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators import relational as R


def dominant_types(layouts: DataFrame) -> DataFrame:
    """(path, dominant): the commonest tensor type, of tensors with two dimensions or more if there are any, first seen among equals."""
    wide = F.filter("tensors", lambda t: F.size(t["dims"]) >= 2)
    rows = layouts.select("path", F.explode(F.when(F.size(wide) > 0, wide).otherwise(F.col("tensors"))).alias("t")).select("path", "t.ggml_type", "t.pos")
    return R.mode_first_seen(rows, ["path"], "ggml_type", "pos").select("path", S.type_name(F.col("ggml_type")).alias("dominant"))


def described(layouts: DataFrame) -> DataFrame:
    """layouts with identity (a digest of the set of names and shapes), stem, dominant type and recipe candidates."""
    identity = F.sha2(F.to_json(F.array_sort(F.array_distinct(F.transform("tensors", lambda t: F.struct(t["name"], t["dims"]))))), 256)
    rows = layouts.withColumn("identity", F.when(F.col("parse_error").isNull(), identity)).withColumn("stem", S.model_stem(F.col("name")))
    rows = rows.join(dominant_types(layouts), "path", "left")
    return rows.withColumn("candidates", S.recipe_candidates(F.col("name"), F.col("dominant")))


def linked_models(files: DataFrame) -> DataFrame:
    """(path, name, role, source, note) of described files.

    The largest file of a float type for each identity and stem is a source, the
    first by name among equals.  Another file belongs to the one source of its
    identity; of several, to the one its stem prefers alone, and to none on a
    tie.  Files without a source carry the reason as a note.
    """
    floats = files.where(F.col("parse_error").isNull() & F.col("dominant").isin(*S.SOURCE_TYPES))
    sources = R.first_by(floats, ["identity", "stem"], [-F.col("file_size"), F.col("name")], ["path", "name"])
    sources = sources.select("identity", F.col("stem").alias("source_stem"), F.col("path").alias("source_path"), F.col("name").alias("source"))
    rest = files.join(sources.select(F.col("source_path").alias("path")), "path", "left_anti")
    pairs = rest.join(sources, "identity").select("path", "stem", "source_stem", "source")
    counts = pairs.groupBy("path").agg(F.count("*").alias("sources"), F.min("source").alias("only"), R.sorted_list("source", joiner=", ").alias("names"))
    winners = R.affinity_winner(pairs, ["path"], "stem", "source_stem", "source")
    rest = rest.join(counts, "path", "left").join(winners, "path", "left")
    chosen = F.when(F.col("sources") == 1, F.col("only")).otherwise(F.col("winner"))
    note = (
        F.when(F.col("parse_error").isNotNull(), F.concat(F.lit("not parseable: "), "parse_error"))
        .when(F.col("sources").isNull(), "no source of a float type shares these tensor names and shapes")
        .when(chosen.isNull(), F.concat(F.lit("ambiguous source: "), "names", F.lit(" share these tensors and the file name prefers none; stored whole")))
    )
    quants = rest.select("path", "name", F.lit("quant").alias("role"), chosen.alias("source"), note.alias("note"))
    none = F.lit(None).cast("string")
    return sources.select(F.col("source_path").alias("path"), F.col("source").alias("name"), F.lit("source").alias("role"), none.alias("source"), none.alias("note")).unionByName(quants)


def linked_matrices(sources: DataFrame, matrices: DataFrame) -> DataFrame:
    """(source, imatrix): each source's importance matrix by stem; the only one of one source always, none on a tie."""
    a = sources.select(F.col("name").alias("source"), S.model_stem(F.col("name")).alias("stem"))
    b = matrices.select(F.col("name").alias("imatrix"), S.model_stem(F.col("name")).alias("matrix_stem"))
    if a.count() == 1 and b.count() == 1:
        return a.crossJoin(b).select("source", "imatrix")
    pairs = R.prefix_pairs(a, b, "stem", "matrix_stem")
    return R.affinity_winner(pairs, ["source"], "stem", "matrix_stem", "imatrix").where(F.col("winner").isNotNull()).withColumnRenamed("winner", "imatrix")
