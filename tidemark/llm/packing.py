"""Conflict-constrained best-fit packing of pieces of documents into bins of a fixed capacity.

A document's length is its number of words (at least 1). Full windows of `capacity` words get bins of their own;
the rest is packed, longest first, into the bin with the least residual that fits. Bins are ordered by residual
and carry bitmaps of the sources and duplicate clusters they hold: the successor search goes on to the next larger
residual until a bin has neither the document's cluster nor its source PER_SOURCE times; else a bin is opened.

Packing is done in shards of about SHARD_ROWS documents dealt by a hash of doc_id, source and text, so that neither a source nor a
cluster gathers in one task; every shard packs all its rows.

Defined results: null and empty texts count one word; a null source is a source of its own; equal texts (null as
empty) are one cluster; a null doc_id is packed like any other; repeated rows are packed each; an empty table gives
an empty result; other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 20_000
SCHEMA = "doc_id long, piece int, bin_id string, bin_offset int, n_words int"


def best_fit(length: list[int], source: list[int], cluster: list[int], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> tuple[list[int], list[int]]:
    """The bin and offset of each item; lengths are 1 to capacity and come longest first."""
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    clusters: list[int] = []  # a bitmap for each bin
    planes: list[list[int]] = []  # per bin, plane k has the sources held more than k times
    bins, offsets = [0] * len(length), [0] * len(length)
    for i, (n, s, c) in enumerate(zip(length, source, cluster, strict=True)):
        s_bit, c_bit = 1 << s, 1 << c
        at = bisect_left(order, (n, -1))
        while at < len(order) and (clusters[order[at][1]] & c_bit or planes[order[at][1]][-1] & s_bit):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(clusters)
            clusters.append(0)
            planes.append([0] * per_source)
        bins[i], offsets[i] = b, capacity - residual
        clusters[b] |= c_bit
        for k, plane in enumerate(planes[b]):
            if not plane & s_bit:
                planes[b][k] |= s_bit
                break
        if residual > n:
            insort(order, (residual - n, b))
    return bins, offsets


def pack_shard(table: pa.Table, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> pa.Table:
    """The pieces of a shard's rows; longest rows first, then by doc_id, null ids first."""
    n, ids, names = table["n_words"].to_numpy(), table["doc_id"], table["cluster"].to_numpy()
    order = np.lexsort((names, ids.fill_null(0).to_numpy(), ~ids.is_null().to_numpy(), -n))
    n, ids, names = n[order], ids.take(pa.array(order)), names[order]
    full = n // capacity
    wide = np.repeat(np.arange(len(n)), full)
    rest = n - full * capacity
    keep = np.argsort(-rest, kind="stable")
    keep = keep[rest[keep] > 0]
    source = pd.factorize(table["source"].take(pa.array(order[keep])).to_pandas(), use_na_sentinel=False)[0].tolist()
    bins, offsets = best_fit(rest[keep].tolist(), source, pd.factorize(names[keep])[0].tolist(), capacity, per_source)
    shard = table["shard"][0].as_py()
    row = np.concatenate((wide, keep))
    piece = np.concatenate((np.arange(len(wide)) - np.repeat(np.cumsum(full) - full, full), full[keep]))
    at = np.concatenate((np.zeros(len(wide), np.int64), np.array(offsets, dtype=np.int64)))
    size = np.concatenate((np.full(len(wide), capacity), rest[keep]))
    bin_id = [f"{shard}-{b}" for b in range(len(wide))] + [f"{shard}-{b + len(wide)}" for b in bins]
    return pa.table([ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(bin_id, pa.string()), pa.array(at, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "piece", "bin_id", "bin_offset", "n_words"])


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, piece (from 0), bin_id, bin_offset, n_words: the pieces of every document with their bins."""
    n_words = F.greatest(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("int")
    shards = common.bucket_count(docs.count(), shard_rows)
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    narrow = docs.select("doc_id", "source", n_words.alias("n_words"), name.alias("cluster")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster"), F.lit(shards)).cast("int"))

    def shard_of(table: pa.Table) -> pa.Table:
        return pack_shard(table, capacity, per_source)

    return narrow.groupBy("shard").applyInArrow(shard_of, SCHEMA)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))


def check_bins(rows: Iterator, capacity: int = CAPACITY) -> None:
    """Raises unless pieces of a bin follow each other without gaps and stay within the capacity."""
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_words"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert at <= capacity


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
