"""Reading packs: rebuilding files, checking all of them, and what they cost."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import guarded_ratio, human_size
from weftline.operators.bytes import BlobStore, emit
from weftline.operators.transform import Quantizer, ToolError
from weftline.plans.packer import derive, digest_of, rebuilt
from weftline.sources.manifest import Entry, Manifest
from weftline.workers import reachable


class RebuildError(RuntimeError):
    """A file can't be given back with the digest that the manifest has."""


def tool_of(manifest: Manifest, explicit: Quantizer | str | None) -> tuple[Quantizer, str]:
    """The tool, and a note if it isn't the build that packed."""
    tool = explicit if isinstance(explicit, Quantizer) else Quantizer.locate(explicit or manifest.tool.get("binary"))
    wanted = manifest.tool.get("sha256")
    return tool, f"the tool's build {tool.sha256[:16]} isn't the one that packed, {wanted[:16]}" if wanted and wanted != tool.sha256 else ""


def inputs(manifest: Manifest, entry: Entry) -> dict[str, Entry]:
    """The stored files that an entry's recipe takes, by role; a missing one is refused."""
    if entry.plan not in ("exact", "near") or not entry.recipe:
        raise RebuildError(f"{entry.filename}: plan {entry.plan!r} can't be carried out")
    out = {}
    for role in ["source"] + ["imatrix"] * bool(entry.recipe["use_imatrix"]):
        of = manifest.of(entry, role)
        if of is None or of.plan != "blob" or not of.blob:
            raise RebuildError(f"{entry.filename}: the pack has no {role} {getattr(entry, role) or ''}".rstrip())
        out[role] = of
    return out


def rebuild(folder: str, manifest: Manifest, entry: Entry, out: str, tool: Quantizer | str | None = None, ready: dict[str, str] | None = None) -> str:
    """Writes an entry's file if its digest is right, else raises and leaves nothing; returns a note on the tool.

    ready has the paths of stored files that are there and checked already, by name.
    """
    store = BlobStore(folder)
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    try:
        if entry.plan == "blob":
            emit(out, store.open(entry.blob), entry.sha256)
            return ""
        with tempfile.TemporaryDirectory() as scratch:
            given = {}
            for role, of in inputs(manifest, entry).items():
                given[role] = (ready or {}).get(of.filename) or os.path.join(scratch, of.filename)
                if not ready or of.filename not in ready:
                    emit(given[role], store.open(of.blob), of.sha256)
            tool, note = tool_of(manifest, tool)
            regen = os.path.join(scratch, "regen.gguf")
            run = derive(tool, given["source"], regen, entry.recipe, given.get("imatrix"))
            if run.returncode:
                raise RebuildError(f"{entry.filename}: the tool failed ({run.returncode}): {run.tail[-400:]}")
            emit(out, rebuilt(store, entry, regen), entry.sha256)
            return note
    except (ValueError, OSError, ToolError) as e:
        raise RebuildError(f"{entry.filename}: {e}") from e


def _each(spark: SparkSession, manifest: Manifest, ords: list[int], work: Callable[[Entry], str]) -> dict[int, str]:
    """What work says of each entry, in a task of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(said=[work(manifest.files[i]) for i in frame["ord"]])

    if not ords:
        return {}
    frame = reachable(spark).createDataFrame([(i,) for i in ords], "ord int").repartition(len(ords), "ord")
    return {r.ord: r.said for r in frame.mapInPandas(run, "ord int, said string").collect()}


def verify(spark: SparkSession, folder: str, tool: Quantizer | str | None = None, scratch: str | None = None, log: Callable[[str], None] = lambda line: None) -> DataFrame:
    """(ord, filename, status) of every entry, each rebuilt in a task of its own; status is OK or FAIL: and the reason.

    Stored files that recipes take are written once, each by one task, into a
    folder that all tasks share (scratch, else beside the pack), whose digests
    that checks as well; it is removed in the end.
    """
    manifest = Manifest.load(folder)
    shared: dict[str, str] = {}
    where = tempfile.mkdtemp(prefix=".verify-", dir=scratch or os.path.dirname(os.path.abspath(folder)))

    def write(entry: Entry) -> str:
        try:
            emit(os.path.join(where, entry.sha256), BlobStore(folder).open(entry.blob), entry.sha256)
            return "OK"
        except (ValueError, OSError) as e:
            return f"FAIL: {entry.filename}: {e}"

    def check(entry: Entry) -> str:
        with tempfile.TemporaryDirectory() as own:
            try:
                rebuild(folder, manifest, entry, os.path.join(own, "out"), tool, shared)
                return "OK"
            except RebuildError as e:
                return f"FAIL: {e}"

    try:
        place = {e.filename: i for i, e in enumerate(manifest.files)}
        taken: set[int] = set()
        for e in manifest.files:
            try:
                taken |= {place[of.filename] for of in inputs(manifest, e).values()}
            except RebuildError:
                pass
        said = _each(spark, manifest, sorted(taken), write)
        shared |= {manifest.files[i].filename: os.path.join(where, manifest.files[i].sha256) for i, s in said.items() if s == "OK"}
        rest = [i for i in range(len(manifest.files)) if i not in taken]
        said |= _each(spark, manifest, rest, check)
    finally:
        shutil.rmtree(where, ignore_errors=True)
    for i in sorted(said):
        log(f"{manifest.files[i].filename}: {said[i]}")
    return spark.createDataFrame([(i, manifest.files[i].filename, said[i]) for i in sorted(said)], "ord int, filename string, status string")


def whole_blobs_hold(spark: SparkSession, folder: str, names: list[str]) -> set[str]:
    """Those of the entries that are stored whole whose blobs give the bytes of their digests; a task reads each."""
    manifest = Manifest.load(folder)
    ords = [i for i, e in enumerate(manifest.files) if e.filename in set(names)]
    said = _each(spark, manifest, ords, lambda e: "OK" if digest_of(BlobStore(folder).open(e.blob)) == e.sha256 else "")
    return {manifest.files[i].filename for i, s in said.items() if s == "OK"}


def blob_status(spark: SparkSession, folder: str) -> DataFrame:
    """(blob, status) of every blob referred to: ok, missing or corrupt."""
    manifest, store = Manifest.load(folder), BlobStore(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for b in frame["blob"]:
                try:
                    store.check(b)
                    out.append("ok")
                except ValueError as e:
                    out.append("missing" if "missing" in str(e) else "corrupt")
            yield frame.assign(status=out)

    blobs = sorted({b for e in manifest.files for b in e.blobs()})
    return reachable(spark).createDataFrame([(b,) for b in blobs], "blob string").repartition(max(1, len(blobs)), "blob").mapInPandas(run, "blob string, status string")


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """(model, filename, plan, recipe, size, stored, ratio, ...): rows for files, models and the whole pack.

    A blob costs the first entry that refers to it, in the order of sections
    (each source with its matrices and quants, then the rest).  The whole pack
    counts the manifest too.  An empty pack has the one row of the whole.
    """
    manifest, store = Manifest.load(folder), BlobStore(folder)
    entries = manifest.frame(spark)
    sizes = spark.createDataFrame([(b, store.size(b)) for b in sorted({b for e in manifest.files for b in e.blobs()})], "blob_id string, bytes long")
    sources = entries.where("role = 'source'").select(F.col("filename").alias("of"), F.col("ord").alias("section"))
    one = sources.agg(F.min_by("of", "section").alias("of")).first()["of"]
    used = entries.where("role = 'quant' and imatrix is not null").select(F.col("imatrix").alias("filename"), F.col("source").alias("s"))
    used = used.join(sources, F.col("s") == F.col("of")).groupBy("filename").agg(F.min_by("of", "section").alias("user"))
    rows = entries.join(used, "filename", "left")
    model = F.when(F.col("role") == "source", F.col("filename")).when(F.col("role") == "imatrix", F.col("user")).otherwise(F.coalesce("source", F.when(F.col("plan") != "blob", F.lit(one))))
    rows = rows.withColumn("of", model).join(sources, "of", "left").withColumn("section", F.coalesce("section", F.lit(1 << 30)))
    refs = rows.select("ord", "section", F.explode(F.array_compact(F.array("header_blob", "delta_blob", "blob"))).alias("blob_id"))
    first = refs.groupBy("blob_id").agg(F.min_by("ord", F.struct("section", "ord")).alias("ord")).join(sizes, "blob_id").groupBy("ord").agg(F.sum("bytes").alias("stored"))
    override = F.col("recipe.token_embedding_type").isNotNull() | F.col("recipe.output_tensor_type").isNotNull()
    label = F.coalesce(F.concat(F.col("recipe.qtype"), F.when(override, "+ovr").otherwise("")), F.lit(""))
    plan = F.when(F.col("role") == "quant", F.col("plan")).otherwise(F.concat("plan", F.lit(" ("), "role", F.lit(")")))
    rows = rows.join(first, "ord", "left").select(F.coalesce("of", F.lit("unmatched")).alias("model"), "section", "ord", "filename", plan.alias("plan"), label.alias("recipe"), "size", F.coalesce("stored", F.lit(0)).alias("stored"))
    totals = rows.rollup("section", "model").agg(F.sum("size").alias("size"), F.sum("stored").alias("stored"), F.grouping_id().alias("level"))
    totals = totals.where("level in (0, 3)")
    extra = F.when(F.col("level") == 3, F.lit(os.path.getsize(os.path.join(folder, "manifest.json")))).otherwise(F.lit(0))
    none = F.lit(None).cast("string")
    totals = totals.select("model", "section", F.lit(1 << 30).alias("ord"), none.alias("filename"), F.when(F.col("level") == 3, "total").otherwise("subtotal").alias("plan"), none.alias("recipe"), F.coalesce("size", F.lit(0)).alias("size"), (F.coalesce("stored", F.lit(0)) + extra).alias("stored"))
    out = rows.unionByName(totals).withColumn("ratio", guarded_ratio(F.col("size"), F.col("stored")))
    return out.withColumn("size_text", human_size(F.col("size"))).withColumn("stored_text", human_size(F.col("stored"))).orderBy(F.col("section").isNull(), "section", "ord", F.col("plan") == "total")


def plan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return Manifest.load(folder).frame(spark).groupBy("plan").count().orderBy("plan")
