"""Folders as tables: names, sizes and kinds of files, and digests of what they hold."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import first_label
from weftline.workers import reachable

CHUNK = 8 << 20


def file_digest(path: str) -> str:
    fold = hashlib.sha256()
    with open(path, "rb") as file:
        while data := file.read(CHUNK):
            fold.update(data)
    return fold.hexdigest()


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, mtime_ns, klass) of the regular, unhidden files of a folder; klass is gguf, imatrix or skipped.

    Listed on the driver: Spark's own listing hides names that begin with an
    underscore, which count here.
    """
    rows = [(e.path, e.name, e.stat().st_size, e.stat().st_mtime_ns) for e in os.scandir(folder) if e.is_file() and not e.name.startswith(".")]
    files = spark.createDataFrame(rows, "path string, name string, size long, mtime_ns long")
    lower = F.lower("name")
    return files.withColumn("klass", first_label([(lower.endswith(".gguf"), "gguf"), (lower.contains("imatrix"), "imatrix")], "skipped"))


def digests(files: DataFrame, path: str = "path") -> DataFrame:
    """files with sha256: each file folded in a task, null where it can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame[path]:
                try:
                    out.append(file_digest(p))
                except OSError:
                    out.append(None)
            yield frame.assign(sha256=out)

    reachable(files.sparkSession)
    n = max(1, files.count())
    return files.repartition(n, path).mapInPandas(run, files.schema.simpleString()[7:-1].replace(":", " ") + ", sha256 string")


def closure(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, size, sha256) of all files under a folder, names relative to it, none with a hidden part."""
    rows = []
    for at, dirs, names in os.walk(folder):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        for n in names:
            full = os.path.join(at, n)
            if not n.startswith(".") and os.path.isfile(full):
                rows.append((os.path.relpath(full, folder).replace(os.sep, "/"), full, os.path.getsize(full)))
    if not rows:
        raise ValueError(f"{folder}: no files")
    return digests(spark.createDataFrame(sorted(rows), "name string, path string, size long"))
