"""Statements as they arrive: each new file of a folder is checked once, exactly, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.plans.statements import check_statements


def arriving_statements(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A stream of (id, text, reasons) for the JSON files of a folder; reasons are empty for a valid statement."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder)
    return check_statements(files.select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text")), kind)


def record_verdicts(statements: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the verdicts to a Parquet table; the checkpoint makes each file count once over restarts."""
    out = statements.select("id", F.sha2("text", 256).alias("sha256"), "reasons", (F.size("reasons") == 0).alias("valid"))
    writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start(table)
