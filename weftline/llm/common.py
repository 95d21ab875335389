"""Helpers that the operators share: scratch tables in the shared folder, splits, packed integers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.workers import reachable, shared_folder

#: A word, as the contracts of the operators give it.
WORD = r"[^\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later reads survive lost executors.

    The table goes when the application ends, not before: results may still read it.
    """
    spark = reachable(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns only, by exact position, whatever else df holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Rows of one key that a sample takes at most: a row that is repeated more often teaches no more.
ROWS_PER_KEY = 8


def few_of_a_key(rows: DataFrame, key: str = "doc_id", order: str = "text") -> DataFrame:
    """rows, of each key the first ROWS_PER_KEY only, by order; each task sends no more than that."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__place", place).where(F.col("__place") <= ROWS_PER_KEY).drop("__place")


def label_sample(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """About per_label rows of each label value, those of least hash: a bounded sample, alike on each run.

    No window and no sort: the counts per label fix a threshold on the hash of the key.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return (
        rows.join(F.broadcast(counts), label)
        .where(spread < F.lit(float(per_label)) / F.col("__n"))
        .drop("__n")
    )


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about so many bytes; a longer text is a run of its own."""
    sizes = np.full(batch.num_rows, 64, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from task to task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, most: int = 2 << 20) -> DataFrame:
    """mapInArrow by slices of about so many bytes of text, which bounds the memory of one step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    reachable(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of ids that may be broadcast: their size is then at most some tens of MB.
BROADCAST_ROWS = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """ids, marked for broadcast if a count shows that they are few; else they are joined by shuffling."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def keep_rows(docs: DataFrame, columns: list[str], keep: Callable[[pa.RecordBatch], np.ndarray], most: int = 2 << 20) -> DataFrame:
    """The rows of docs, with all their columns, for which keep (given the named columns of a batch) says so."""
    places = [docs.columns.index(c) for c in columns]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.select(places)), pa.bool_()))

    return map_batches(docs, one, docs.schema, most)


def pack(values: np.ndarray, width: int | None = None) -> bytes:
    """Unsigned integers as one byte of width and so many little-endian bytes each."""
    values = np.ascontiguousarray(values, dtype="<u8")
    if width is None:
        width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)
