"""What the corpus operators share: the shared folder, tables written to it, byte-level numpy helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word patterns: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir; a temporary one only where that is unset on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scope:
    """Collects what written() writes inside a `with` block of this thread, and deletes it by release().

    Scopes are apart from each other and from everything written outside, so that a pipeline only ever deletes its own
    tables. Tables outside any scope are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self._token = _SCOPE.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self._token)

    def release(self, keep: int = 0) -> None:
        """Deletes the scope's tables but the last `keep`; for callers whose result is written and reads no others."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if scope := _SCOPE.get():
        scope.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(total: int, each: int, least: int = 1) -> int:
    """As many buckets as hold `each` units each; grows with the input."""
    return max(least, -(-int(total) // each))


def words(text: Column) -> Column:
    """The runs of characters that are not white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, join) -> Column:
    """The running join (an associative function, such as a sum) of an array, itself included; null adds nothing.

    Each pass joins twice as many: n log n steps for an array of any size, where a sum for each place takes n^2.
    """
    def double(a: Column, k: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            y = F.get(a, i - F.call_function("shiftleft", F.lit(1), k))
            return F.when(y.isNull(), x).when(x.isNull(), y).otherwise(join(y, x))

        return F.transform(a, step)

    passes = F.when(F.size(values) > 1, F.ceil(F.log2(F.size(values))).cast("int")).otherwise(0)
    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), passes), values, double)


def matches(text: Column, pattern: Column | str) -> Column:
    """array of struct(start, end, m, before): leftmost matches that do not overlap, in code points; before: the text
    since the match before."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern).alias("pieces"))

    def all_of(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, k: F.length(m) + F.length(F.get(x["pieces"], k)))

        def one(ends: Column) -> Column:
            return F.transform(x["found"], lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("end"), m.alias("m"), F.get(x["pieces"], k).alias("before")))

        return F.when(F.size(x["found"]) > 0, let(scanned(sizes, lambda a, b: a + b), one)).otherwise(F.array())

    return let(both, all_of)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place where possible."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out[0] = 1
        np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:]) if n > 1 else None
    return out


class Slices:
    """Hashes of arbitrary slices of a byte array by prefix sums: sum of byte * B^i, shifted back by B^-start."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.inverse = _powers(_BASE_INVERSE, n + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def batches(values: list, limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Index ranges over values (bytes) of about limit bytes each, never splitting one."""
    out, start, held = [], 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            out.append((start, i))
            start, held = i, 0
        held += len(v)
    if start < len(values):
        out.append((start, len(values)))
    return out
