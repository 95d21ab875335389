"""Labelled rows to learn from: a bounded sample of the texts that a label table marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_of_a_key, held_out, label_sample, stage, with_columns

#: Rows of each label value, about, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 1 << 15


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE_ROWS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """The rows of labelled_texts, and how many rows of each label they were taken from."""
    marks = with_columns(labels, ["doc_id", label]).withColumnRenamed(label, "label")
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    usable = with_columns(docs, ["doc_id", "text"]).where(F.octet_length("text") <= SAMPLE_BYTES)
    # written once, as counting and choosing read it and the lengths take a scan of the texts
    marks = stage(usable.select("doc_id").join(marks, "doc_id"), "labelled")
    counts = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = label_sample(marks, "label", per_label).distinct()
    rows = few_of_a_key(usable.join(F.broadcast(chosen), "doc_id"))
    return [(r.text, r.label) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.text))], counts


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """(text, label) of about per_label rows of each label, held-out rows apart, in the order of doc_id.

    Rows with a null id, label or text teach nothing, nor do texts above
    SAMPLE_BYTES or labels of absent rows, and none of them count; several labels
    of one id count as the greatest.  The sample is by hash of doc_id, with ROWS_PER_KEY
    rows of an id at most, so it is bounded before a text is collected.
    """
    return labelled_sample(docs, labels, label, per_label)[0]
