"""Logs as a sink: JSON lines appended to a folder that is rotated by size or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CURRENT, ROTATED = "current", "rotated"


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_log(rows: DataFrame, folder: str, max_bytes: int = 5 << 20, max_lines: int | None = None) -> None:
    """Append ``rows`` to the log's current part; a part that is over a limit becomes the rotated one, in place of the last."""
    spark = rows.sparkSession
    rows.write.mode("append").json(f"{folder}/{CURRENT}")
    current, fs = _files(spark, f"{folder}/{CURRENT}")
    full = fs.getContentSummary(current).getLength() > max_bytes
    if full or max_lines is not None and spark.read.text(f"{folder}/{CURRENT}").count() > max_lines:
        rotated, _ = _files(spark, f"{folder}/{ROTATED}")
        fs.delete(rotated, True)
        fs.rename(current, rotated)


def read_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the rotated and the current part."""
    parts = []
    for name in (ROTATED, CURRENT):
        path, fs = _files(spark, f"{folder}/{name}")
        if fs.exists(path):
            parts.append(f"{folder}/{name}")
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)
