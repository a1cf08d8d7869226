"""Minimax contiguous partition: the smallest shard capacity over ordered atomic groups, found by binary search.

Groups are the documents of equal text, ordered by a 128-bit hash of the text; a group never splits. The prefix
sums of the groups are a written table, range-partitioned by that order, so that a greedy check only looks up the
last group within a budget: each round tries PROBES capacities at once, and all lookups of a step are one job.

Defined results: a null text counts as size 1 and as its own group, apart from the empty text; with fewer groups
than shards the last shards stay empty; an empty table gives an empty result; repeated rows keep a slot each.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
PROBES = 24
#: Groups are summed up in at most about this many chunks for the driver.
CHUNKS = 2048
#: Chunks of at most so many groups are looked through on the driver once fetched; larger ones by an aggregate.
FETCH_GROUPS = 50_000


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    t = F.col("text")
    return docs.select(
        "doc_id", _size(t).alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(t, F.lit(1)).alias("g1"), F.xxhash64(F.lit("second"), t).alias("g2"),
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A written table sorted by `order` over all partitions, with _part and the row's number `_row` in its part."""
    parts = common.partitions(df.sparkSession)
    by_range = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = by_range.withColumn("_id", F.monotonically_increasing_id())
    return common.written(packed.withColumns({"_part": F.call_function("shiftright", F.col("_id"), F.lit(33)).cast("int"), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), name)


def offsets(parts: DataFrame, *columns: str) -> DataFrame:
    """For each part, the sums of the columns over the parts before it; a row for each shuffle partition."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long").alias(f"_before_{c}") for c in columns))


def prefix_sums(keys: DataFrame) -> DataFrame:
    """g1, g2, size, n, upto (sum of sizes, itself included), rows (count likewise), in the order of the groups."""
    groups = keys.groupBy("g1", "g2").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = numbered(groups, ["g1", "g2"], "groups")
    before = offsets(rows.groupBy("_part").agg(F.sum("size").alias("size"), F.sum("n").alias("n")), "size", "n")
    w = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"upto": F.sum("size").over(w), "rows": F.sum("n").over(w)}).join(before, "_part")
    out = running.select("g1", "g2", "size", "n", (F.col("upto") + F.col("_before_size")).alias("upto"), (F.col("rows") + F.col("_before_n")).alias("rows"))
    return common.written(out, "prefix")


class Lookup:
    """The last group whose prefix sum is within each of some budgets; exact, one job for all of them."""

    def __init__(self, prefix: DataFrame, total: int) -> None:
        self.width = max(1, -(-total // CHUNKS))
        self.prefix = prefix.withColumn("chunk", F.floor((F.col("upto") - 1) / self.width).cast("int"))
        found = self.prefix.groupBy("chunk").agg(F.min("upto").alias("least"), F.max("upto").alias("most"), F.count("*").alias("n")).collect()  # at most CHUNKS + 1 rows
        self.rows = {r["chunk"]: r["n"] for r in found}
        self.fetched: dict[int, list[int]] = {}
        self.chunks = sorted((r["least"], r["most"], r["chunk"]) for r in found)
        self.least = [c[0] for c in self.chunks]
        self.known: dict[int, int] = {}

    def floor(self, budgets: set[int]) -> dict[int, int]:
        """For each budget, the largest prefix sum that is not over it (0 if none)."""
        inside = []
        for b in budgets - self.known.keys():
            k = bisect_right(self.least, b) - 1
            if k < 0:
                self.known[b] = 0
            elif b >= self.chunks[k][1]:
                self.known[b] = self.chunks[k][1]
            else:
                inside.append((b, self.chunks[k][2], self.chunks[k][0]))
        wanted: set[int] = set()
        for c in sorted({c for _, c, _ in inside} - self.fetched.keys()):
            if sum(self.rows[x] for x in wanted) + self.rows[c] <= FETCH_GROUPS:
                wanted.add(c)
        if wanted:
            self.fetched |= {c: [] for c in wanted}
            for r in self.prefix.where(F.col("chunk").isin(sorted(wanted))).select("chunk", "upto").collect():  # FETCH_GROUPS at most
                self.fetched[r["chunk"]].append(r["upto"])
            for c in wanted:
                self.fetched[c].sort()
        self.known |= {b: self.fetched[c][bisect_right(self.fetched[c], b) - 1] for b, c, _ in inside if c in self.fetched}
        inside = [x for x in inside if x[1] not in self.fetched]
        if inside:
            within = self.prefix.where(F.col("chunk").isin(sorted({c for _, c, _ in inside})))
            names = [F.max(F.when((F.col("chunk") == c) & (F.col("upto") <= b), F.col("upto"))).alias(f"b{k}") for k, (b, c, _) in enumerate(inside)]
            row = within.agg(*names).first()
            self.known |= {b: row[f"b{k}"] for k, (b, _, _) in enumerate(inside)}
        return {b: self.known[b] for b in budgets}


def cuts(lookup: Lookup, total: int, largest: int, shards: int) -> list[int]:
    """Prefix sums at which the shards end, for the smallest capacity that needs no more than `shards` of them."""
    low, high, best = max(-(-total // shards), largest), -(-total // shards) + largest, None
    while best is None or low < high:
        step = max(1, -(-(high - low) // PROBES))
        tried = sorted({min(high, low + k * step) for k in range(PROBES + 1)})
        ends = {c: [0] for c in tried}
        for _ in range(shards):
            at = lookup.floor({e[-1] + c for c, e in ends.items() if e[-1] < total})
            for c, e in ends.items():
                if e[-1] < total:
                    e.append(at[e[-1] + c])
        good = [c for c in tried if ends[c][-1] == total]
        high, best = good[0], ends[good[0]]
        low = max([c + 1 for c in tried if c < high], default=high)
    return best[1:]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: slots follow doc_id within a shard and have no gaps."""
    keys = common.written(keyed(docs), "shard_keys")
    prefix = prefix_sums(keys)
    head = prefix.agg(F.max("upto").alias("total"), F.max("size").alias("largest")).first()
    ends = cuts(Lookup(prefix, head["total"]), head["total"], head["largest"], shards) if head["total"] else []
    last = {r["upto"]: (r["g1"], r["g2"]) for r in prefix.where(F.col("upto").isin(ends)).select("upto", "g1", "g2").collect()} if ends else {}
    number = F.lit(0)
    for g1, g2 in (last[e] for e in ends[:-1]):  # at most shards - 1 literals
        number = number + F.when((F.col("g1") > g1) | ((F.col("g1") == g1) & (F.col("g2") > g2)), 1).otherwise(0)
    placed = numbered(keys.withColumn("shard", number.cast("int")).drop("g1", "g2"), ["shard", "doc_id"], "placed")
    counts = placed.groupBy("_part", "shard").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    w = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).drop("n", "first")
    out = placed.join(starts, ["_part", "shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_row") + F.col("start")).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def brute_cuts(sizes: list[int], shards: int) -> list[int]:
    """Plain binary search, for the tests: prefix sums at the ends of the shards."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)

    def ends(c: int) -> list[int]:
        out = [0]
        while out[-1] < prefix[-1] and len(out) <= shards:
            out.append(prefix[bisect_right(prefix, out[-1] + c) - 1])
        return out[1:]

    low, high = max(sizes), prefix[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ends(mid)[-1] == prefix[-1] else (mid + 1, high)
    assert all(b - a <= low for a, b in pairwise([0, *ends(low)]))
    return ends(low)


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
