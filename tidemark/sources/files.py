"""Reading and landing tables: bars, signals with their metadata, and folders that all machines see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder only where that is unset on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a new path of the shared folder and reads it back: computed once, and safe from lost executors. The
    table goes when the application ends."""
    path, jvm = shared_path(df.sparkSession, name), df.sparkSession._jvm
    df.write.parquet(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normal_bars(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """Lower-case names with _ for blanks; the ticker, or else the given symbol, as `symbol`."""
    out = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns)).withColumnsRenamed({"ticker": "symbol", "datetime": "ts", "date": "ts"})
    return out if symbol is None or "symbol" in out.columns else out.withColumn("symbol", F.lit(symbol))


def many(bars: DataFrame, universe: DataFrame, keep_missing: bool = False) -> DataFrame:
    """The bars of the universe's distinct symbols; with keep_missing, a row of nulls for a symbol without bars."""
    wanted = universe.select("symbol").distinct()
    return wanted.join(bars, "symbol", "left") if keep_missing else bars.join(wanted, "symbol", "left_semi")


def write_cache(bars: DataFrame, path: str) -> None:
    """One folder a symbol, so that readers of few symbols open few files; an earlier cache at path is replaced."""
    bars.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_cache(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("symbol").isin(symbols))


def normal_metadata(metadata: DataFrame) -> DataFrame:
    """key, value of a metadata table that is either that already or one wide row."""
    if {"key", "value"} <= set(metadata.columns):
        return metadata.select("key", F.col("value").cast("string").alias("value"))
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in metadata.columns))
    return metadata.select(F.inline(entries))


def with_columns_of(signals: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The given columns (name: type), each a typed null where the table lacks it; numbers may come as text."""
    def column(name: str, kind: str):
        if name not in signals.columns:
            return F.lit(None).cast(kind).alias(name)
        value = F.col(name).try_cast(kind)
        return (F.when(~F.isnan(value), value) if kind == "double" else value).alias(name)

    return signals.select(*(column(n, k) for n, k in columns.items()))
