"""A cache of rebuilt files: <root>/<digest of the manifest>/<file>, least recently used first out."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import parse_size
from weftline.operators.relational import evict_oldest
from weftline.plans.rebuild import rebuild
from weftline.sources.folders import file_digest
from weftline.sources.manifest import FILE, Manifest

SIDECAR, SHORTEST_ID = ".pack.json", 8
ENTRIES = "pack_id string, pack_path string, path string, filename string, size long, mtime double"


def cache_root() -> str:
    return os.environ.get("WEFTLINE_CACHE") or os.path.join(os.path.expanduser("~"), ".cache", "weftline")


def pack_id(folder: str) -> str:
    return file_digest(os.path.join(folder, FILE))


def _sidecar(folder: str) -> dict:
    try:
        with open(os.path.join(folder, SIDECAR)) as file:
            data = json.load(file)
        return data if isinstance(data, dict) else {}
    except (OSError, ValueError):
        return {}


def cached(spark: SparkSession, root: str | None = None) -> DataFrame:
    """(pack_id, pack_path, path, filename, size, mtime) of all cached files."""
    root, rows = root or cache_root(), []
    for pack in sorted(os.scandir(root), key=lambda e: e.name) if os.path.isdir(root) else []:
        if pack.is_dir() and not pack.name.startswith("."):
            where = _sidecar(pack.path).get("pack_path")
            rows += [(pack.name, where, e.path, e.name, e.stat().st_size, e.stat().st_mtime) for e in os.scandir(pack.path) if e.is_file() and not e.name.startswith(".")]
    return spark.createDataFrame(rows, ENTRIES).orderBy("pack_id", "filename")


def get(spark: SparkSession, folder: str, name: str, tool=None, root: str | None = None) -> str:
    """Path of the verified file; rebuilt only if the cache hasn't it with the right digest. Then an environment cap holds."""
    root = root or cache_root()
    manifest = Manifest.load(folder)
    entry = manifest.find(spark, name)
    if entry is None:
        raise LookupError(f"nothing in the pack is called {name!r}")
    ident = pack_id(folder)
    path = os.path.join(root, ident, entry.filename)
    if os.path.isfile(path) and file_digest(path) == entry.sha256:
        os.utime(path)
    else:
        if os.path.exists(path):
            os.unlink(path)
        rebuild(folder, manifest, entry, path, tool)
        with open(os.path.join(root, ident, SIDECAR), "w") as file:
            json.dump({"pack_path": os.path.abspath(folder), "manifest_sha256": ident}, file)
    if cap := os.environ.get("WEFTLINE_CACHE_MAX"):
        most = size_of(spark, cap)
        if most is not None:  # a malformed cap is as good as none
            evict(spark, most, protect=path, root=root)
    return path


def size_of(spark: SparkSession, text: str) -> int | None:
    return spark.range(1).select(parse_size(F.lit(text)).alias("n")).first()["n"]


def evict(spark: SparkSession, most: int, protect: str = "", root: str | None = None) -> DataFrame:
    """Removes cached files, oldest first, until at most so many bytes stay; (path, size) of those removed.

    The protected file counts but stays; equal times go by path.
    """
    rows = cached(spark, root)
    gone = evict_oldest(rows, "mtime", "path", "size", lambda total: F.lit(most), F.col("path") == protect).select("path", "size").collect()
    for r in gone:
        os.unlink(r.path)
        folder = os.path.dirname(r.path)
        if not [n for n in os.listdir(folder) if n != SIDECAR]:
            shutil.rmtree(folder)
    return spark.createDataFrame(gone, "path string, size long")


def clear(spark: SparkSession, pack: str | None = None, root: str | None = None) -> int:
    """Removes cached packs: all, or those that a pack folder, its path or name, an id or eight characters or more of one mean."""
    root = root or cache_root()
    ids = {e.name: _sidecar(e.path).get("pack_path") for e in os.scandir(root) if e.is_dir()} if os.path.isdir(root) else {}
    if pack is not None:
        live = pack_id(pack) if os.path.isfile(os.path.join(pack, FILE)) else None
        table = spark.createDataFrame([(i, p) for i, p in ids.items()], "id string, at string")
        by_path = (F.col("at") == os.path.abspath(pack)) | (F.element_at(F.split("at", "/"), -1) == pack) | (F.col("id") == pack)
        by_start = F.col("id").startswith(pack) if len(pack) >= SHORTEST_ID else F.lit(False)
        ids = {r.id: r.at for r in table.where(F.col("id") == live if live else by_path | by_start).collect()}
    for i in ids:
        shutil.rmtree(os.path.join(root, i))
    return len(ids)
