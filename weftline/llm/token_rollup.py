"""Token totals by source, language and tokenizer version, kept up by signed changes in idempotent batches."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, shared_folder, with_columns
from .tokenizer import encode

KEYS = ["source", "lang", "tokenizer"]
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """(doc_id, source, lang, n_tokens) for each row of docs (doc_id, text, source, lang, ...): tokens of the whole text, 0 for null."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [len(encode(sent.value, t)) if t else 0 for t in batch.column(3).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    return map_batches(with_columns(docs, ["doc_id", "source", "lang", "text"]), one, "doc_id long, source string, lang string, n_tokens long", most=1 << 20)


def inserts(counts: DataFrame, tokenizer: str) -> DataFrame:
    """Signed changes that add the rows of counts (source, lang, n_tokens)."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("d_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("d_tokens"))


def deletes(counts: DataFrame, tokenizer: str) -> DataFrame:
    """Signed changes that take the rows of counts away again."""
    rows = inserts(counts, tokenizer)
    return rows.withColumns({"d_docs": -F.col("d_docs"), "d_tokens": -F.col("d_tokens")})


def revisions(before: DataFrame, after: DataFrame, tokenizer: str, new_tokenizer: str | None = None) -> DataFrame:
    """Signed changes from counts as they were to counts as they are; source, language or tokenizer may have changed too."""
    return deletes(before, tokenizer).unionByName(inserts(after, new_tokenizer or tokenizer))


class TokenRollup:
    """Totals as a folder of committed batches, each the sum of its changes by key.

    A batch is written aside and renamed to its id, which is atomic: a batch
    that failed half-way leaves nothing, and one committed again, in whole or by
    a second writer, changes nothing.  Null keys are keys like others, and null
    changes count 0.  A batch of no changes is a commit too.  compact() sums up
    the batches into one and names them in it, so their ids stay known.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("batches", "bases"):
            self._fs.mkdirs(self._path(f"{self.folder}/{d}"))

    def _names(self, part: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")))

    def _base(self) -> str | None:
        """The folder of the newest base: its totals, and the ids that it sums up."""
        names = self._names("bases")
        return f"{self.folder}/bases/{names[-1]}" if names else None

    def _ids(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch_id string").parquet(f"{base}/ids")

    def _loose(self, base: str | None) -> list[str]:
        """The batches that the base doesn't sum up; asked for those that have a folder only, however many there ever were."""
        names = self._names("batches")
        if base is None or not names:
            return names
        listed = self.spark.createDataFrame([(n,) for n in names], "batch_id string")
        return sorted(r.batch_id for r in listed.join(self._ids(base), "batch_id", "left_anti").collect())

    def has(self, batch_id: str) -> bool:
        """Whether the batch is in, as a folder of its own or in the newest base."""
        if self._fs.exists(self._path(f"{self.folder}/batches/{batch_id}")):
            return True
        base = self._base()
        return base is not None and bool(self._ids(base).where(F.col("batch_id") == batch_id).limit(1).count())

    def committed(self) -> DataFrame:
        """(batch_id) of every batch that is in."""
        base = self._base()
        rows = self.spark.createDataFrame([(n,) for n in self._loose(base)], "batch_id string")
        return rows.unionByName(self._ids(base)) if base else rows

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the changes (source, lang, tokenizer, d_docs, d_tokens); False if the batch is in already."""
        if not batch_id or "/" in batch_id or batch_id[0] in "._":
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.has(batch_id):
            return False
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("d_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("d_tokens"), F.lit(0)).alias("n_tokens"))
        sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)).write.parquet(aside)
        return self._publish(aside, f"{self.folder}/batches/{batch_id}")

    def _publish(self, aside: str, to: str) -> bool:
        target = self._path(to)
        done = not self._fs.exists(target) and self._fs.rename(self._path(aside), target)
        if done and self._fs.exists(self._path(f"{to}/{self._path(aside).getName()}")):
            # another writer's folder was there by then, and the rename went into it
            self._fs.delete(self._path(f"{to}/{self._path(aside).getName()}"), True)
            done = False
        if not done:
            self._fs.delete(self._path(aside), True)
        return bool(done)

    def _sums(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{base}/totals"] * bool(base) + [f"{self.folder}/batches/{n}" for n in batches]
        rows = self.spark.read.schema(_TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], _TOTALS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens), keys whose totals are both 0 left out."""
        base = self._base()
        return self._sums(base, self._loose(base))

    def compact(self) -> None:
        """Sums up the batches that are in now into a new base.

        They are listed once, and the base names exactly what it sums up, so a
        batch committed meanwhile stays one of its own.  What the new base
        replaces stays until the next call, for readers that have begun; what
        the base before it replaced goes.
        """
        base = self._base()
        listed, loose = self._names("batches"), self._loose(base)
        old = self._names("bases")
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        self._sums(base, loose).coalesce(1).write.parquet(f"{aside}/totals")
        ids = self.spark.createDataFrame([(i,) for i in loose], "batch_id string")
        (ids.unionByName(self._ids(base)) if base else ids.coalesce(1)).write.parquet(f"{aside}/ids")
        if self._publish(aside, f"{self.folder}/bases/{(int(old[-1]) if old else 0) + 1:012d}"):
            for n in old[:-1]:
                self._fs.delete(self._path(f"{self.folder}/bases/{n}"), True)
            for n in sorted(set(listed) - set(loose)):
                self._fs.delete(self._path(f"{self.folder}/batches/{n}"), True)
