"""Lines of text files in their order, whatever tasks read them.

Spark splits a file by bytes and says where each split begins; within a split, rows come in the file's order. So (file,
start of the split, place in the task) orders the lines of all files without any of them passing through one task, on
every file system that Spark reads. Files are ordered by their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def placed(spark: SparkSession, path: str) -> DataFrame:
    """line, place: struct(file, start, at), which orders the lines."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return d.select("line", F.struct("file", "start", "at").alias("place"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 in each file), line, place: a count for each split, and numbers within it."""
    d = placed(spark, path)
    split = [F.col("place.file").alias("file"), F.col("place.start").alias("start")]
    counts = d.groupBy(*split).agg(F.count("*").alias("n"))
    before = counts.select("file", "start", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = d.select("line", "place", *split).withColumn("k", F.row_number().over(Window.partitionBy("file", "start").orderBy("place.at")))
    return inside.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("k")).alias("line_no"), "line", "place")


def last(lines: DataFrame, n: int, order: Column | str = "place") -> DataFrame:
    """The last n lines that are not blank, newest first."""
    order = F.col(order) if isinstance(order, str) else order
    return lines.where(F.trim("line") != "").orderBy(order.desc()).limit(n)
