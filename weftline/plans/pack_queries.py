"""Queries that run the engine on tensor files from end to end: a ladder of files for each region, written to the shared folder, and what its plans say of them."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.operators.transform import Converter
from weftline.plans import cache, rebuild, sample_tool, samples, statements
from weftline.plans.identity import described, linked_models
from weftline.plans.packer import pack
from weftline.plans.prune import prune
from weftline.plans.registry import query
from weftline.sources.folders import digests, scan_folder
from weftline.sources.layouts import read_layouts
from weftline.sources.manifest import Manifest
from weftline.workers import reachable, shared_folder

_PACKED: dict[tuple[str, str], tuple[str, str, str]] = {}

#: The files of each ladder, as SQL: kind, role, plan, type of the recipe, its override.
_KINDS = "(values ('f16', 'source', 'blob', null, null), ('Q8_0', 'quant', 'exact', 'Q8_0', null), ('Q4_K_L', 'quant', 'exact', 'Q4_K_M', 'q8_0'), ('Q6_K', 'quant', 'near', 'Q6_K', null), ('odd', 'quant', 'blob', null, null)) k(kind, role, plan, qtype, override)"


def packed(region: DataFrame) -> tuple[str, str, str]:
    """(folder, pack, tool) of the ladders of all regions, made once in a session."""
    spark = region.sparkSession
    names = sorted(r.r_name for r in region.select("r_name").collect())
    key = (spark.sparkContext.applicationId, ",".join(names))
    if key not in _PACKED:
        at = f"{shared_folder(spark)}/ladders-{uuid.uuid4().hex}"
        samples.write_ladders(region.select(F.col("r_name").alias("name")), f"{at}/models")
        tool = samples.write_tool(f"{at}/quantize")
        pack(spark, f"{at}/models", f"{at}/pack", tool)
        _PACKED[key] = f"{at}/models", f"{at}/pack", tool
    return _PACKED[key]


@query(
    """select s_suppkey, s_suppkey % 7 = 3 broken, case when s_suppkey % 7 <> 3 then alignment end alignment, case when s_suppkey % 7 <> 3 then cast(ceil(head * 1.0 / alignment) * alignment as bigint) end data_start,
    case when s_suppkey % 7 <> 3 then s_suppkey % 3 + 1 end n_tensors, case when s_suppkey % 7 <> 3 then s_suppkey + 1 end last_dim
    from (select s_suppkey, alignment, 24 + (8 + 12 + 4 + 8 + strlen(s_name)) + case when alignment <> 32 then 8 + 17 + 4 + 4 else 0 end + (s_suppkey % 3 + 1) * (8 + 2 + 4 + 16 + 4 + 8) head
          from (select s_suppkey, s_name, cast(32 * power(2, s_suppkey % 4) as int) alignment from supplier))""",
    "supplier",
)
def gguf_layout_scan(supplier):
    """A tensor file for each supplier, some cut short, read back by the data source."""
    spark = supplier.sparkSession
    folder = f"{shared_folder(spark)}/layouts-{uuid.uuid4().hex}"
    os.makedirs(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, name in zip(frame["s_suppkey"], frame["s_name"], strict=True):
                path = f"{folder}/{k}.gguf"
                sample_tool.write_tensors(path, {"general.name": name}, [(f"t{i}", (4, k + 1), 0, struct.pack("<q", i)) for i in range(k % 3 + 1)], 32 << k % 4)
                if k % 7 == 3:
                    os.truncate(path, 20 + k % 5)
            yield frame[["s_suppkey"]]

    keys = [r.s_suppkey for r in reachable(spark) and supplier.select("s_suppkey", "s_name").mapInPandas(run, "s_suppkey long").collect()]
    rows = read_layouts(spark, [f"{folder}/{k}.gguf" for k in keys]).withColumn("s_suppkey", F.regexp_extract("name", r"^(\d+)", 1).cast("long"))
    last = F.try_element_at(F.try_element_at("tensors", F.lit(-1))["dims"], F.lit(-1))
    ok = F.col("parse_error").isNull()
    return rows.select(
        "s_suppkey",
        (~ok).alias("broken"),
        F.when(ok, F.col("alignment")).alias("alignment"),
        F.when(ok, F.col("data_start")).alias("data_start"),
        F.when(ok, F.size("tensors").cast("long")).alias("n_tensors"),
        F.when(ok, last).alias("last_dim"),
    )


@query(f"select r_name || '-' || kind || '.gguf' filename, role, plan, qtype, override, case when qtype is not null then r_name || '-f16.gguf' end source, kind = 'Q6_K' has_delta from region, {_KINDS}", "region")
def pack_plans(region):
    """What packing finds for each file: the cheapest plan that gives it back."""
    _, out, _ = packed(region)
    rows = Manifest.load(out).frame(region.sparkSession)
    return rows.select(
        "filename", "role", "plan", F.col("recipe.qtype").alias("qtype"), F.col("recipe.token_embedding_type").alias("override"), "source", F.col("delta_blob").isNotNull().alias("has_delta")
    )


@query(f"select plan, count(*) n from region, {_KINDS} group by plan", "region")
def pack_plan_counts(region):
    _, out, _ = packed(region)
    return rebuild.plan_counts(region.sparkSession, out).select("plan", F.col("count").alias("n"))


@query(f"select r_name || '-' || kind || '.gguf' filename, kind <> 'Q6_K' ok from region, {_KINDS}", "region")
def pack_verify(region):
    """Every file rebuilt and checked, in a copy of the pack whose one delta, alike for all that nearly derive, has a changed byte."""
    folder, out, tool = packed(region)
    copy = f"{out}-{uuid.uuid4().hex}"
    shutil.copytree(out, copy)
    first = min((e for e in Manifest.load(copy).files if e.delta_blob), key=lambda e: e.filename)
    samples.flip(f"{copy}/blobs/{first.delta_blob}", 3)
    rows = rebuild.verify(region.sparkSession, copy, tool)
    shutil.rmtree(copy)
    return rows.select("filename", (F.col("status") == "OK").alias("ok"))


@query("select 'ok' status, 2 * count(*) + 1 n from region", "region")
def pack_blobs(region):
    """The pack's blobs, each read and held against its address: sources, files stored whole, and one delta that several share."""
    _, out, _ = packed(region)
    rows = rebuild.blob_status(region.sparkSession, out)
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("select r_name || '-Q8_0.gguf' filename, true same from region union all select r_name || '-Q6_K.gguf', true from region", "region")
def pack_rebuild(region):
    """Derived files taken out of the pack through the cache, and their digests held against the originals'."""
    folder, out, tool = packed(region)
    spark, root = region.sparkSession, f"{out}-cache-{uuid.uuid4().hex}"
    for r in region.select("r_name").collect():
        for kind in ("Q8_0", "Q6_K"):
            cache.get(spark, out, f"{r.r_name}-{kind}.gguf", tool, root)
    own = digests(cache.cached(spark, root).select("filename", "path")).select("filename", F.col("sha256").alias("got"))
    then = digests(scan_folder(spark, folder).select(F.col("name").alias("filename"), "path")).select("filename", F.col("sha256").alias("want"))
    return own.join(then, "filename").select("filename", (F.col("got") == F.col("want")).alias("same"))


@query("select r_name || '-Q8_0.gguf' filename, row_number() over (order by r_name) <= 2 evicted from region", "region")
def cache_eviction(region):
    """The cache's files by age, all of one size, kept down to so many bytes that the two oldest go."""
    _, out, tool = packed(region)
    spark, root = region.sparkSession, f"{out}-cache-{uuid.uuid4().hex}"
    names = sorted(r.r_name for r in region.select("r_name").collect())
    for i, name in enumerate(names):
        os.utime(cache.get(spark, out, f"{name}-Q8_0.gguf", tool, root), (1000 + i, 1000 + i))
    rows = cache.cached(spark, root).collect()
    before = spark.createDataFrame([(r.filename,) for r in rows], "filename string")
    most = sum(sorted(r["size"] for r in rows)[2:])
    gone = [(os.path.basename(r.path),) for r in cache.evict(spark, most, root=root).collect()]
    left = [r.filename for r in cache.cached(spark, root).collect()]
    assert sorted(left + [g[0] for g in gone]) == sorted(r.filename for r in rows)
    return before.join(spark.createDataFrame(gone, "gone string"), F.col("filename") == F.col("gone"), "left").select("filename", F.col("gone").isNotNull().alias("evicted"))


@query(
    f"""select r_name || '-' || kind || '.gguf' filename, case when role = 'source' or kind = 'Q6_K' then 'kept' else 'deleted' end action,
    case when role = 'source' then 'source' when kind = 'Q6_K' then '--keep' end reason from region, {_KINDS}""",
    "region",
)
def prune_actions(region):
    """Originals that a pack gives back are removed from a copy of the folder, those to be kept and sources stay."""
    folder, _, tool = packed(region)
    spark, copy = region.sparkSession, f"{folder}-{uuid.uuid4().hex}"
    shutil.copytree(folder, copy)
    manifest = pack(spark, copy, f"{copy}.pack", tool)
    rows = prune(spark, copy, f"{copy}.pack", manifest, ["Q6_K"])
    kept = {r.filename for r in rows.where("action = 'kept'").collect()}
    assert set(os.listdir(copy)) == kept
    return rows.select("filename", "action", "reason")


@query(f"select r_name || '-' || kind || '.gguf' filename, coalesce(qtype || case when override is not null then '+ovr' else '' end, '') recipe, case when kind = 'odd' then 'unmatched' else r_name || '-f16.gguf' end model from region, {_KINDS}", "region")
def pack_stats(region):
    """The rows of files in a pack's statistics; totals are checked to add up on the way."""
    _, out, _ = packed(region)
    rows = rebuild.stats(region.sparkSession, out)
    sums = rows.agg(F.sum(F.when(F.col("filename").isNotNull(), F.col("size"))).alias("a"), F.sum(F.when(F.col("plan") == "total", F.col("size"))).alias("b"), F.sum(F.when(F.col("plan") == "subtotal", F.col("size"))).alias("c")).first()
    assert sums.a == sums.b == sums.c
    return rows.where("filename is not null").select("filename", "recipe", "model")


@query("select 'Q8_0' asked, count(*) n from region union all select 'Q4_K_L', count(*) from region union all select 'q4_k_m', count(*) from region union all select min(r_name) || '-odd.gguf', 1 from region union all select 'Q5_0', 0", "region")
def pack_names(region):
    """How many entries a name asks for: a file name, the end of one, or a recipe's type."""
    _, out, _ = packed(region)
    spark, manifest = region.sparkSession, Manifest.load(out)
    first = min(r.r_name for r in region.collect())
    asked = ["Q8_0", "Q4_K_L", "q4_k_m", f"{first}-odd.gguf", "Q5_0"]
    return spark.createDataFrame([(a, len(manifest.find_all(spark, a))) for a in asked], "asked string, n long")


@query(
    "select step, said from (values ('attest', 'Q8_0'), ('verify', ''), ('convert', 'f16'), ('verify conversion', ''), ('chain', ''), ('another build', 'verified with another build than the attester''s'), ('other bytes', 'TAMPER-EVIDENT: the attesting build itself gives other bytes'), ('a file more', 'extra: outside the attested closure'), ('not linked', 'refused')) x(step, said)",
    "region",
)
def statement_chain(region):
    """Both statements from a snapshot to a derived file: made, verified, linked, and refused when something was changed."""
    spark = region.sparkSession
    name = min(r.r_name for r in region.collect())
    at = f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
    snapshot = f"{at}/{name.lower().replace(' ', '-')}-repo"
    os.makedirs(snapshot)
    for file in ("config.json", "model.safetensors", "README.md"):
        with open(f"{snapshot}/{file}", "w") as f:
            f.write(f"{name} {file}")
    tool, converter, source, quant = samples.write_tool(f"{at}/quantize"), Converter.locate(script=samples.SCRIPT), f"{at}/x-f16.gguf", f"{at}/x-Q8_0.gguf"
    converter.run(snapshot, source)
    sample_tool.derive(source, quant, "Q8_0")
    leaf, root, out = f"{at}/leaf.json", f"{at}/root.json", []

    def refusal(function, *args) -> str:
        try:
            function(*args)
        except statements.VerifyFailed as e:
            return str(e)
        return "accepted"

    made = statements.attest(spark, quant, source, None, tool)
    statements.save_statement(made, leaf)
    out.append(("attest", made["predicate"]["recipe"]["quantType"]))
    out.append(("verify", statements.verify(spark, leaf, tool)))
    whole = statements.attest_conversion(spark, source, snapshot, converter)
    statements.save_statement(whole, root)
    out.append(("convert", whole["predicate"]["recipe"]["outputType"]))
    out.append(("verify conversion", statements.verify_conversion(spark, root, converter)))
    out.append(("chain", "; ".join(statements.verify_chain(spark, leaf, root, tool, converter))))
    out.append(("another build", statements.verify(spark, leaf, samples.write_tool(f"{at}/other", "another build"))))
    wrong = made | {"subject": [{"name": "none.gguf", "digest": {"sha256": "1" * 64}}]}
    wrong["predicate"] = made["predicate"] | {"reproducibility": made["predicate"]["reproducibility"] | {"reDerivedDigest": {"sha256": "1" * 64}}}
    statements.save_statement(wrong, f"{at}/wrong.json")
    out.append(("other bytes", refusal(statements.verify, spark, f"{at}/wrong.json", tool)))
    with open(f"{snapshot}/extra", "w") as f:
        f.write("x")
    out.append(("a file more", refusal(statements.verify_conversion, spark, root, converter)))
    wrong["predicate"] = wrong["predicate"] | {"baseModel": made["predicate"]["baseModel"] | {"digest": {"sha256": "2" * 64}}}
    statements.save_statement(wrong, f"{at}/wrong.json")
    linked = refusal(statements.verify_chain, spark, f"{at}/wrong.json", root, tool, converter)
    out.append(("not linked", "refused" if "aren't linked" in linked else linked))
    shutil.rmtree(at)
    return spark.createDataFrame(out, "step string, said string")


_TYPES = "(values ('Q8_0'), ('q4_k_m'), ('Q4_K_L'), ('IQ2_M'), ('f16'), ('Final')) t(t)"


@query(f"select p_partkey, t, upper(t) suffix, case when t = 'Final' then p_name || '-Final' else p_name end stem from part, {_TYPES}", "part")
def model_names(part):
    """Stem and type of file names such as <part>-<type>.gguf."""
    kinds = F.explode(F.array(*[F.lit(t) for t in ("Q8_0", "q4_k_m", "Q4_K_L", "IQ2_M", "f16", "Final")]))
    rows = part.select("p_partkey", "p_name", kinds.alias("t"))
    name = F.concat("p_name", F.lit("-"), "t", F.lit(".gguf"))
    return rows.select("p_partkey", "t", S.type_suffix(name).alias("suffix"), S.model_stem(F.concat(F.lit("/a.b/"), name)).alias("stem"))


@query(
    """select o_orderkey, case when n < 1024 then format('{:,d} B', n) when n < 1048576 then format('{:,.1f} KiB', n / 1024.0) when n < 1073741824 then format('{:,.1f} MiB', n / 1048576.0) else format('{:,.1f} GiB', n / 1073741824.0) end text,
    cast(o_orderkey % 1000 as bigint) * 1048576 parsed from (select o_orderkey, cast(case o_orderkey % 4 when 0 then o_orderkey when 1 then o_orderkey * 1024 else floor(o_totalprice * 10000) end as bigint) n from orders)""",
    "orders",
)
def size_texts(orders):
    """Sizes written for people, and sizes that people write."""
    key = F.col("o_orderkey")
    n = F.when(key % 4 == 0, key).when(key % 4 == 1, key * 1024).otherwise(F.floor(F.col("o_totalprice") * 10000)).cast("long")
    return orders.select("o_orderkey", S.human_size(n).alias("text"), S.parse_size(F.concat((key % 1000).cast("string"), F.lit(" mb"))).alias("parsed"))


@query(f"select r_name || '-' || kind || '.gguf' name, 'gguf' klass, true folded from region, {_KINDS}", "region")
def folder_scan(region):
    """The files of a folder by kind, each folded to a digest in a task."""
    folder, _, _ = packed(region)
    return digests(scan_folder(region.sparkSession, folder)).select("name", "klass", (F.length("sha256") == 64).alias("folded"))


@query(
    f"""select r_name || '-' || kind || '.gguf' name, role, case when kind not in ('f16', 'odd') then r_name || '-f16.gguf' end source,
    case when kind = 'odd' then 'not parseable' end note from region, {_KINDS}""",
    "region",
)
def model_links(region):
    """Which file derives from which: all sources have the same tensors, so names decide."""
    folder, _, _ = packed(region)
    spark = region.sparkSession
    paths = sorted(r.path for r in scan_folder(spark, folder).collect())
    links = linked_models(described(read_layouts(spark, paths)))
    return links.select("name", "role", "source", F.substring_index("note", ":", 1).alias("note"))


@query(
    f"""select r_name || '-' || kind || '.gguf' name, r_name stem, case kind when 'Q4_K_L' then 'Q4_K' when 'f16' then 'F16' else kind end dominant, coalesce(qtype, 'F16') first_candidate
    from region, {_KINDS} where kind <> 'odd'""",
    "region",
)
def model_types(region):
    """Stem, commonest tensor type and the recipe to try first for each file that can be read."""
    folder, _, _ = packed(region)
    spark = region.sparkSession
    paths = sorted(r.path for r in scan_folder(spark, folder).collect())
    rows = described(read_layouts(spark, paths)).where("parse_error is null")
    return rows.select("name", "stem", "dominant", F.try_element_at("candidates", F.lit(1)).alias("first_candidate"))
