"""Bars stored in buckets of symbols: joins and windows by symbol read them without a shuffle, newer bars are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

BUCKETS = 32


def store(bars: DataFrame, name: str, buckets: int = BUCKETS, batch: int = 0) -> str:
    """Writes bars as the table `name` in the shared folder, in buckets of symbols sorted by symbol and time. One file a
    bucket, so that Spark may rely on their order."""
    out = bars.withColumn("batch", F.lit(batch).cast("long")).repartition(buckets, "symbol")
    out.write.bucketBy(buckets, "symbol").sortBy("symbol", "ts").option("path", files.shared_path(bars.sparkSession, name)).format("parquet").saveAsTable(name)
    return name


def upsert(bars: DataFrame, name: str) -> None:
    """Appends bars that are new or differ from the stored ones under the next batch number; the rest is left alone.

    A bar that is stored as given is not written again, so a repeated upsert appends nothing.
    """
    spark = bars.sparkSession
    columns = [c for c in spark.table(name).columns if c != "batch"]
    last = spark.table(name).agg(F.max("batch")).head()[0]  # one number
    known = read(spark, name)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
    new = bars.alias("n").join(known.alias("k"), (F.col("n.symbol") == F.col("k.symbol")) & (F.col("n.ts") == F.col("k.ts")), "left").where(F.col("k.symbol").isNull() | differs)
    rows = files.kept(new.select(*(F.col(f"n.{c}").alias(c) for c in columns)), "newer")
    if not rows.isEmpty():
        rows.withColumn("batch", F.lit((last or 0) + 1).cast("long")).select(*spark.table(name).columns).write.insertInto(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The newest version of each bar. The window stays inside the buckets: no shuffle."""
    w = Window.partitionBy("symbol", "ts").orderBy(F.desc("batch"))
    return spark.table(name).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")
