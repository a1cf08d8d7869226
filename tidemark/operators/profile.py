"""Table profiles, tails and log progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, name: str, at: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "first", "last")


def tail(df: DataFrame, key: str, at: str, n: int, columns: tuple[str, ...]) -> DataFrame:
    """The last n rows of each key, with the given columns only; rows that lack one of them go."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return df.select(key, at, *columns).dropna(subset=list(columns)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def refresh_progress(log: DataFrame, order: str = "line_no") -> DataFrame:
    """done, total from lines "Forecast a/b", and the last line that is not blank."""
    part = lambda k: F.max(F.regexp_extract("line", r"Forecast (\d+)/(\d+)", k).try_cast("int"))
    return log.agg(part(1).alias("done"), part(2).alias("total"), F.max_by("line", F.when(F.trim("line") != "", F.col(order))).alias("last_line"))


#: Settings under which Spark answers counts and extremes from Parquet footers, without reading data pages.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footers(spark: SparkSession, path: str, at: str) -> tuple[int, str | None, str | None, int]:
    """(rows, first, last, columns) of a Parquet table from its files' footers."""
    before = {k: spark.conf.get(k) for k in FOOTERS}
    try:
        for k, v in FOOTERS.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(path)
        text = lambda c: F.when(c.isNotNull(), c.cast("string"))
        r = df.agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).select("n", text(F.col("a")).alias("a"), text(F.col("b")).alias("b")).head()
        return r["n"] or 0, r["a"], r["b"], len(df.columns)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def manifest(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> DataFrame:
    """name, n_rows, n_columns, first, last, error of each table, given as its path and its ordering column.

    Paths are probed: a table that is not there, is unreadable or holds no files has nothing but its error (`missing`,
    `unreadable`, `empty`), and stops no other. One row a table.
    """
    rows = []
    for name, (path, at) in tables.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            rows.append((name, None, None, None, None, "missing"))
        elif fs.getFileStatus(where).isDirectory() and not any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(where)):
            rows.append((name, None, None, None, None, "empty"))
        else:
            try:
                n, first, last, columns = footers(spark, path, at)
                rows.append((name, n, columns, first, last, None))
            except Exception:  # noqa: BLE001 - whatever a reader says of a table that it cannot read
                rows.append((name, None, None, None, None, "unreadable"))
    return spark.createDataFrame(rows, "name string, n_rows long, n_columns int, first string, last string, error string")
