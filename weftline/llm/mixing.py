"""Mixing sources to target weights: hash-random order within a source, distributed prefix sums, an exact cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage, with_columns

#: Rows of one source that one range of its random order holds, about.
ROWS_PER_RANGE = 4096


def source_targets(sizes: DataFrame, weights: list[float], epochs: int) -> DataFrame:
    """(source, source_size, n, target) for each source, from (source, source_size, n).

    Sources in code-point order, null last, weigh weights[0], weights[1], ...,
    repeating, and share the sum of all sizes; a target stops at epochs times
    its source's size, and the excess is shared by weight among the others until
    none is above.  That is min(level * weight, cap) for the one level at which
    the targets add up; sources sorted by cap / weight give it by prefix sums.
    The table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights) + 1
    rows = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place")))
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * epochs).withColumn("full", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full", "place", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    here_on = Window.orderBy("full", "place", F.col("source").isNull(), "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on)
    rows = rows.withColumn("level", level)
    # The first source whose cap the level doesn't reach fixes the level for all that follow.
    fixed = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = fixed["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return rows.select("source", "source_size", "n", target.alias("target"))


def mix_sources(docs: DataFrame, weights: list[float] | None = None, epochs: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of docs (doc_id, text, source, ...).

    size is the number of words [^\\x20\\x09-\\x0D]+ in the text (null, empty or
    blank: 0); weights default to 1, 2, 3.  Each source is put in a random order
    by the first 48 bits of md5('seed:doc_id') and read round and round until floor(target)
    words are taken: whole rounds first, then documents in that order, the last
    one in part.  So the words taken of a source are its target rounded down,
    and no document gives more than epochs times its size.  Ties of the hash go
    by doc_id and size, and rows equal in all three are interchangeable, so
    reruns agree; a null doc_id or source is a value like others.  No rows in:
    none out.  Other columns are ignored.
    """
    docs = with_columns(docs, ["doc_id", "text", "source"])
    light = stage(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    totals = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = source_targets(totals, weights or [1.0, 2.0, 3.0], epochs)
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long"))
    plan = stage(
        plan.withColumn("rest", F.greatest(F.floor("target") - F.col("rounds") * F.col("source_size"), F.lit(0)).cast("long"))
        .withColumn("ranges", F.ceil(F.col("n") / ROWS_PER_RANGE).cast("long"))
        .withColumnRenamed("source", "of"),
        "mix-plan",
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = light.withColumn("key", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")).join(plan, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("range", F.shiftrightunsigned(F.shiftrightunsigned("key", 16) * F.col("ranges"), 32))
    sums = rows.groupBy("of", "range").agg(F.sum("size").alias("sum"))
    start = F.coalesce(F.sum("sum").over(Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("of").alias("start_of"), F.col("range").alias("start_range"), start.alias("start"))
    rows = rows.join(starts, F.col("of").eqNullSafe(F.col("start_of")) & (F.col("range") == F.col("start_range")))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = F.col("rounds") * F.col("size") + F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")
