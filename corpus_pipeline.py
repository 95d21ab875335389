"""A training corpus from documents: toxic texts, texts in no known language, near duplicates and benchmark copies go, then sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import held_out, stage
from weftline.llm.decontaminate import without_contaminated
from weftline.llm.language_id import fit_language_id, in_known_language
from weftline.llm.mixing import mix_sources
from weftline.llm.ngram_join import drop_near_duplicates
from weftline.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more; null and empty texts stay."""
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.5)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) or that no language codes better than unknown bytes."""
    return in_known_language(docs, fit_language_id(docs.where(~held_out(F.col("doc_id")))))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.75): the one of least id, null last; of equal rows any one."""
    return drop_near_duplicates(docs, n=5, share=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item; an empty benchmark drops none."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=0.5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many; sources weigh 1, 2, 3, repeating, and are read three times at most.

    A null source is one like others, after them; documents without words are not taken.
    """
    return mix_sources(docs, weights=[1.0, 2.0, 3.0], epochs=3, seed=42).where(F.col("taken") > 0)


STAGES = [
    ("toxicity", toxicity),
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Learned stages and alignments have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    Columns that documents has besides its own are carried along.  Repeated rows
    and ids, nulls in any column and empty tables are as each stage says; a
    table of no rows gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
