"""Streams of JSON lines: strict parsing with a status, first arrivals within a watermark, windowed totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import strict_json


def json_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """source, text, value (variant), status of each line that arrives in ``path``; blank lines are left out, broken ones FAILED."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where(F.trim("value") != "")
    v = strict_json(F.col("value"))
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), v.alias("value"), F.when(v.isNull(), "FAILED").otherwise("PROCESSED").alias("status"))


def first_arrivals(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """One row of each key while its repetitions are at most ``late`` apart; the state is bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_totals(stream: DataFrame, keys: list[str], value: str, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, keys, n, total of each tumbling window; rows later than the watermark are left out."""
    sums = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("window.start").alias("start"), *keys, "n", "total")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there to Parquet, exactly once for a checkpoint, and stops."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
