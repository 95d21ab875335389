"""Removing originals that a pack provably gives back: everything is checked before anything is removed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.rebuild import RebuildError, blob_status, inputs, whole_blobs_hold
from weftline.sources.folders import digests, scan_folder
from weftline.sources.manifest import Manifest, ManifestError, snapshot_diff


class PruneRefused(RuntimeError):
    """Nothing was removed."""


class PruneError(ValueError):
    """What to keep can't be told."""


def prune(spark: SparkSession, originals: str, folder: str, manifest: Manifest, keep: list[str] | None = None) -> DataFrame:
    """(filename, action, reason, bytes): originals of derived files removed, all others kept with the reason."""
    try:
        on_disk = Manifest.load(folder)
    except (ManifestError, FileNotFoundError) as e:
        raise PruneRefused(str(e)) from e
    if snapshot_diff(on_disk, manifest):
        raise PruneRefused("the manifest on disk isn't the one just written")
    kept: set[str] = set()
    for name in keep or []:
        found = manifest.find_all(spark, name)
        if not found:
            raise PruneError(f"nothing in the pack is called {name!r}")
        kept |= {e.filename for e in found}
    entries = manifest.frame(spark).select("filename", "role", "sha256", F.col("size").alias("bytes"))
    here = scan_folder(spark, originals).select(F.col("name").alias("filename"), "path", "mtime_ns", F.col("size").alias("now"))
    reason = F.when(F.col("role") != "quant", F.col("role")).when(F.col("filename").isin(*kept) if kept else F.lit(False), "--keep").when(F.col("path").isNull(), "not there")
    rows = entries.join(here, "filename", "left").withColumn("reason", reason)
    doomed = {r.filename: r for r in digests(rows.where("reason is null").withColumnRenamed("sha256", "wanted")).collect()}
    by_name = {e.filename: e for e in manifest.files}
    bad = {r.blob: r.status for r in blob_status(spark, folder).where("status <> 'ok'").collect()}
    needed: dict[str, object] = {}
    for name, r in sorted(doomed.items()):
        entry = by_name[name]
        if r.sha256 != r.wanted:
            raise PruneRefused(f"{name}: changed since it was packed")
        if entry.plan == "blob":
            needed[name] = entry
        else:
            try:
                needed |= {of.filename: of for of in inputs(manifest, entry).values()}
            except RebuildError as e:
                raise PruneRefused(str(e)) from e
        for blob in entry.blobs():
            if blob in bad:
                raise PruneRefused(f"{name}: blob {blob[:16]} is {bad[blob]}")
    for name, entry in sorted(needed.items()):
        if entry.blob in bad:
            raise PruneRefused(f"{name}: blob {entry.blob[:16]} is {bad[entry.blob]}")
    lost = sorted(set(needed) - whole_blobs_hold(spark, folder, sorted(needed)))
    if lost:
        raise PruneRefused(f"{lost[0]}: its blob doesn't hold it")
    for name, r in doomed.items():
        now = os.stat(r.path)
        if (now.st_size, now.st_mtime_ns) != (r.now, r.mtime_ns):
            raise PruneRefused(f"{name}: changed while it was checked")
    action = F.when(F.col("reason").isNull(), "deleted").otherwise("kept")
    result = rows.where("reason is null or reason <> 'not there'").select("filename", action.alias("action"), "reason", "bytes").orderBy("filename").collect()
    for r in doomed.values():
        os.unlink(r.path)
    return spark.createDataFrame(result, "filename string, action string, reason string, bytes long")
