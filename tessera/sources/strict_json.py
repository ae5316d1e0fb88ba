"""Strict JSON scans: duplicate keys, non-finite numbers and broken text give a failed row, not a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import strict_json


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """source, content, value (variant), status of each file under ``path``; other suffixes are SKIPPED, what is no object or array or not UTF-8 FAILED."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), "content")
    text = F.col("content").cast("string")
    v = F.when(F.is_valid_utf8(text), strict_json(text))
    ok = F.rlike(F.schema_of_variant(v), F.lit("^(OBJECT|ARRAY)"))
    return files.select("source", "content", v.alias("value"), F.when(~F.rlike("source", F.lit(r"(?i)\.json$")), "SKIPPED").when(v.isNull() | ~ok, "FAILED").otherwise("PROCESSED").alias("status"))


def enumerated(spark: SparkSession, path: str) -> DataFrame:
    """source, size, modified of all regular files under ``path``, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line (from 1, blank ones counted), value, status; blank lines are left out. Files are split: lines are numbered in their block, blocks by the lines before them."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("source", "block").orderBy("at"))).join(offsets, ["source", "block"])
    v = strict_json(F.col("text"))
    return numbered.where(F.trim("text") != "").select("source", (F.col("i") + F.col("before")).alias("line"), v.alias("value"), F.when(v.isNull(), "FAILED").otherwise("PROCESSED").alias("status"))
