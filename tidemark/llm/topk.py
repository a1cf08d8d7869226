"""Exact top-k by inner product with cover trees over data and queries, traversed together.

Vectors are dealt into blocks of bounded size by their nearest pivot, round by round: a cell that is still too large
gets pivots of its own, from a sample of its rows (pivots only place rows). Every block has a cover tree of its data
and one of its queries: a node of level l holds rows within 2^l of its centre, a row; its children, of level l - 1,
have centres more than 2^(l - 1) apart, the first one its own; a node of few rows, or of rows nearly as far apart as
they are from its centre, has none. A pair of a query node and a data node is left out when
its largest possible product, c_q.c_d + r_q |c_d| + r_d |c_q| + r_q r_d, is below the worst kth score of the node's
queries; the radii are the covering radii. Blocks hang on branches under the same bound: pairs of branches are pruned
first, then pairs of whole blocks by the blocks' roots and the kth scores that queries find in their own block, then
single queries by the block's root; what is left is searched block by block and merged.

Scores are whole numbers: products in doubles where no partial sum can reach 2^53, else in longs, else in unbounded
integers, cut to the range of a long.

Defined results: vectors that are null, empty, or hold null, NaN or infinite components take no part; nor do rows
without a vec_id; components and scores beyond a long become its largest or smallest value; vectors of different
lengths do not meet; of a repeated vec_id every row is a candidate for other ids and every row is a query, whose
results are pooled (so only the K first of rows equal in id and vector can matter); ties go to the smaller vec_id; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, SCALE = 20, 20, 64
#: Rows of a block; pivots of the first round; pivots of a cell that is split again; rounds.
BLOCK_ROWS, PIVOTS, SUB_PIVOTS, ROUNDS = 4096, 512, 16, 8
LEAF, QUERY_LEAF = 256, 64
#: Rows so far apart that a node would have a child for fewer than CROWD of them stay a leaf: no radius tells them apart.
CROWD = 8
LONG = np.iinfo(np.int64)
VECTOR = "vec_id long, dim int, v binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(df: DataFrame) -> DataFrame:
    """vec_id, dim, v: floor(64 x) of every component as little-endian int64 bytes; of equal rows the first K."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, values = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not x or any(y is None for y in x):
                    continue
                scaled = np.floor(np.asarray(x, dtype=np.float64) * SCALE)
                if np.isfinite(np.asarray(x, dtype=np.float64)).all():
                    # the largest double below 2^63 is 2^63 - 1024
                    whole = np.where(scaled >= 2.0**63, LONG.max, np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype("<i8"))
                    ids.append(i)
                    dims.append(len(x))
                    values.append(whole.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(values, pa.binary())], names=["vec_id", "dim", "v"])

    rows = df.select("vec_id", "embedding").mapInArrow(run, VECTOR)
    counts = rows.groupBy("vec_id", "dim", "v").agg(F.count("*").alias("n"))
    return counts.select("vec_id", "dim", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(K)).cast("int"))).alias("_")).drop("_")


def matrix(values, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<i8").reshape(-1, dim)


def _most(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


class Node:
    """A node of a cover tree over the rows of x (doubles); see the module text for what holds of levels."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, level: int | None, leaf: int) -> None:
        points = x[rows]
        apart = np.sqrt(((points - x[centre]) ** 2).sum(axis=1))
        self.rows, self.centre, self.radius = rows, x[centre], float(apart.max())
        self.norm = float(np.sqrt((self.centre**2).sum()))
        self.children: list[Node] = []
        top = int(np.ceil(np.log2(self.radius))) if self.radius > 0 else 0
        # levels at which the node would have itself as its only child are passed over
        self.level = top if level is None else min(level, top)
        if len(rows) <= leaf or self.radius == 0:
            return
        # squares from one product a centre; a hair is left for their rounding
        square = (points**2).sum(axis=1)
        least, nearest, home, centres = 4.0 ** (self.level - 1) * (1 + 1e-9), apart**2, np.zeros(len(rows), dtype=np.int64), [centre]
        while nearest[pick := int(nearest.argmax())] > least:
            if len(centres) * CROWD > len(rows):
                return
            d = square + (square[pick] - 2 * (points @ points[pick]))
            d[pick] = 0
            closer = d < nearest
            nearest[closer], home[closer] = d[closer], len(centres)
            centres.append(int(rows[pick]))
        self.children = [Node(x, rows[home == k], c, self.level - 1, leaf) for k, c in enumerate(centres)]
        self.centres = np.stack([c.centre for c in self.children])
        self.radii, self.norms = (np.array([getattr(c, n) for c in self.children]) for n in ("radius", "norm"))


def largest(c: np.ndarray, norm: float, radius: float, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The largest products of vectors around c with vectors around each of the centres, and a little more."""
    room = radius * norms + radii * norm + radius * radii
    return centres @ c + room + 1e-6 + 1e-9 * (norm * norms + room)


class Search:
    """Queries against one block of data; kth: what each query has found elsewhere (a score that k others reach)."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, kth: np.ndarray, k: int = K) -> None:
        order = np.argsort(ids, kind="stable")
        self.q_ids, self.k, self.ids, x = q_ids, k, ids[order], x[order]
        bound = _most(q) * _most(x) * x.shape[1]
        kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
        self.q, self.x = q.astype(kind), x.astype(kind)
        self.kth = kth.astype(np.int64).copy()
        self.score = [np.empty(0, dtype=np.int64)] * len(q)
        self.found = [np.empty(0, dtype=np.int64)] * len(q)
        if len(q) and len(ids):
            a, b = q.astype(np.float64), x.astype(np.float64)
            self.queries, self.data = Node(a, np.arange(len(q)), 0, None, QUERY_LEAF), Node(b, np.arange(len(ids)), 0, None, LEAF)
            self.walk(self.queries, self.data)

    def walk(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            worst = float(self.kth[a.rows].min())
            if largest(a.centre, a.norm, a.radius, b.centre[None], np.array([b.norm]), np.array([b.radius]))[0] < worst:
                continue
            if a.children and (not b.children or a.radius >= b.radius):
                stack += [(c, b) for c in a.children]
            elif b.children:
                near = np.flatnonzero(largest(a.centre, a.norm, a.radius, b.centres, b.norms, b.radii) >= worst)
                near = near[np.argsort(b.centres[near] @ a.centre, kind="stable")]
                # children without children meet the queries together, the best ones of the others are next
                last = [b.children[c].rows if b.children[c].radius else self.smallest(b.children[c].rows) for c in near.tolist() if not b.children[c].children]
                stack += [(a, b.children[c]) for c in near.tolist() if b.children[c].children]
                if last:
                    self.split(a, np.sort(np.concatenate(last)))
            else:
                self.split(a, np.sort(b.rows) if b.radius else self.smallest(b.rows))

    def smallest(self, rows: np.ndarray) -> np.ndarray:
        """Of equal vectors, those that can matter: the rows of the k smallest ids and of one more, the query's own."""
        rows = np.sort(rows)  # rows are in the order of ids
        new = np.concatenate(([True], self.ids[rows[1:]] != self.ids[rows[:-1]]))
        return rows[np.cumsum(new) <= self.k + 1]

    def split(self, a: Node, at: np.ndarray) -> None:
        for k in range(0, len(a.rows), QUERY_LEAF):
            self.meet(a.rows[k : k + QUERY_LEAF], at)

    def meet(self, rows: np.ndarray, at: np.ndarray) -> None:
        score = self.q[rows] @ self.x[at].T
        score = (np.clip(score, LONG.min, LONG.max) if score.dtype == object else score).astype(np.int64)
        hit = (score >= self.kth[rows][:, None]) & (self.ids[at] != self.q_ids[rows][:, None])
        for r in np.flatnonzero(hit.any(axis=1)).tolist():
            i, new = int(rows[r]), np.flatnonzero(hit[r])
            if len(new) > 4 * self.k:  # the k best and their ties are enough
                new = new[score[r, new] >= np.partition(score[r, new], len(new) - self.k)[len(new) - self.k]]
            s = np.concatenate((self.score[i], score[r, new]))
            f = np.concatenate((self.found[i], self.ids[at[new]]))
            if len(s) > self.k:
                best = np.lexsort((f, ~s))[: self.k]  # ~s falls as s grows, and never leaves the longs
                s, f = s[best], f[best]
            self.score[i], self.found[i] = s, f
            if len(s) == self.k:
                self.kth[i] = max(self.kth[i], s.min())

    def frame(self) -> pd.DataFrame:
        n = [len(s) for s in self.score]
        none = np.empty(0, np.int64)
        return pd.DataFrame({"query_id": np.repeat(self.q_ids, n), "vec_id": np.concatenate([*self.found, none]), "score": np.concatenate([*self.score, none])})


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (2 * x @ pivots.T - (pivots**2).sum(axis=1)).argmax(axis=1)


def placed(vectors: DataFrame, block_rows: int) -> DataFrame:
    """vectors with their block: cells of nearest pivots, split again by pivots of their own while they are too large;
    what no pivot splits (equal vectors) is split by a hash."""
    n = vectors.count()
    want = min(PIVOTS, max(1, n // block_rows))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).collect()  # at most PIVOTS rows
    pivots = {d: matrix([r["v"] for r in sample if r["dim"] == d], d).astype(np.float64) for d in {r["dim"] for r in sample}}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(dims), dtype=np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d in pivots:
                    cell[at] = _nearest(matrix([batch.column(2)[i].as_py() for i in at.tolist()], d).astype(np.float64), pivots[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "dim", "v", "cell"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, sub = batch.column(3).to_numpy().copy(), np.zeros(batch.num_rows, dtype=np.int32)
            for i, (d, v, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if p is not None:
                    sub[i] = 1 + _nearest(matrix([v], d).astype(np.float64), matrix(p, d).astype(np.float64))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(sub)], names=["vec_id", "dim", "v", "cell", "sub"])

    cells = common.written(vectors.mapInArrow(first, VECTOR + ", cell long"), "cells")
    counts = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    for k in range(ROUNDS):
        large = counts.where(F.col("n") > 2 * block_rows)
        if large.isEmpty():
            break
        order = F.xxhash64("vec_id", F.lit(k))
        some = cells.join(large, ["dim", "cell"]).where(F.pmod(order, F.greatest(F.lit(1), F.floor(F.col("n") / (4 * SUB_PIVOTS)))) == 0)
        some = some.groupBy("dim", "cell").agg(F.slice(F.array_sort(F.collect_set("v")), 1, SUB_PIVOTS).alias("p"))
        joined = cells.join(some, ["dim", "cell"], "left").select("vec_id", "dim", "v", "cell", "p").mapInArrow(again, VECTOR + ", cell long, sub int")
        cells = common.written(joined.withColumn("cell", F.when(F.col("sub") > 0, F.xxhash64("cell", "sub", F.lit(k))).otherwise(F.col("cell"))).drop("sub"), "cells")
        before, counts = large.agg(F.sum("n")).first()[0], cells.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        if (counts.where(F.col("n") > 2 * block_rows).agg(F.sum("n")).first()[0] or 0) >= 0.9 * before:
            break
    key = F.xxhash64("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / (2 * block_rows))))
    return cells.join(counts, ["dim", "cell"]).select(key.alias("block"), "vec_id", "dim", "v")


def is_query(ids: np.ndarray) -> np.ndarray:
    return ids % EVERY == 0


OWN = FOUND + ", block long, dim int, centre binary, radius double, q_centre binary, q_radius double, worst long"


def own_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a block's queries find in it, and one row (without query_id) on the roots of its two trees and the worst
    kth score of its queries."""
    dim = int(pdf["dim"].iloc[0])
    ids, x = pdf["vec_id"].to_numpy(), matrix(pdf["v"], dim)
    q = is_query(ids)
    search = Search(ids[q], x[q], ids, x, np.full(int(q.sum()), LONG.min))
    data = search.data if q.any() else Node(x.astype(np.float64), np.arange(len(ids)), 0, None, len(ids))
    root = lambda n: (n.centre.astype("<f8").tobytes(), n.radius)
    found = search.frame().astype(object)
    more = (int(pdf["block"].iloc[0]), dim, *root(data), *(root(search.queries) if q.any() else (None, None)), int(search.kth.min()) if q.any() else None)
    rows = [(*r, *[None] * 7) for r in found.itertuples(index=False)] + [(None, None, None, *more)]
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in OWN.split(", ")], dtype=object)
    return out.astype({"query_id": "Int64", "vec_id": "Int64", "score": "Int64", "block": "Int64", "dim": "Int32", "radius": "Float64", "q_radius": "Float64", "worst": "Int64"})


def _centre(raw: bytes) -> tuple[np.ndarray, float]:
    c = np.frombuffer(raw, dtype="<f8")
    return c, float(np.sqrt(c @ c))


def _hopeful(df: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """The columns `keep` of rows (q_centre, q_radius, worst, centre, radius) whose bound reaches the worst kth score."""
    bound = ["q_centre", "q_radius", "worst", "centre", "radius"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in bound), strict=True)
            hope = []
            for k, (q, q_radius, worst, c, radius) in enumerate(rows):
                (a, norm), (b, other) = _centre(q), _centre(c)
                if largest(a, norm, q_radius, b[None], np.array([other]), np.array([radius]))[0] >= worst:
                    hope.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(hope, pa.int64())) for c in keep], names=keep)

    return df.select(*keep, *(c for c in bound if c not in keep)).mapInArrow(run, schema)


def _ball(centres: list[bytes], radii: list[float]) -> tuple[bytes, float]:
    """A ball around balls: the mean of their centres, and a radius that covers them all."""
    x = np.stack([np.frombuffer(c, dtype="<f8") for c in centres])
    mean = x.mean(axis=0)
    return mean.astype("<f8").tobytes(), float((np.sqrt(((x - mean) ** 2).sum(axis=1)) + np.array(radii)).max() * (1 + 1e-12))


def branches(summaries: DataFrame) -> DataFrame:
    """summaries with `branch`: blocks dealt to the nearest of about as many pivot blocks as the root of their number."""
    want = min(PIVOTS, math.isqrt(summaries.count()) + 1)
    pivots: dict[int, np.ndarray] = {}
    for r in summaries.orderBy(F.xxhash64("block"), "block").limit(want).select("dim", "centre").collect():  # at most PIVOTS rows
        pivots[r["dim"]] = np.concatenate([pivots.get(r["dim"], np.empty((0, r["dim"]))), [_centre(bytes(r["centre"]))[0]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, centres = batch.column("dim").to_pylist(), batch.column("centre").to_pylist()
            at = [int(_nearest(_centre(c)[0][None], pivots[d])[0]) if d in pivots else 0 for d, c in zip(dims, centres, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "branch"])

    return summaries.mapInArrow(run, SUMMARY + ", branch int")


SUMMARY = "block long, dim int, centre binary, radius double, q_centre binary, q_radius double, worst long"


def block_pairs(summaries: DataFrame) -> DataFrame:
    """(block, other, centre, radius): data blocks that may hold better scores for the queries of `other`.

    Two levels above the blocks' own trees: blocks hang on branches, whose balls cover theirs and whose worst kth score
    is their least. Pairs of branches are pruned first, so that whole branches of blocks go at once; blocks only meet
    within the pairs of branches that are left, and are pruned by their roots. There are at most PIVOTS^2 pairs of
    branches a length of vectors, dealt out by the data branch.
    """
    placed = common.written(branches(summaries.select(*(c.split()[0] for c in SUMMARY.split(", ")))), "branches")

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, radius = _ball(pdf["centre"].tolist(), pdf["radius"].tolist())
        asked = pdf[pdf["q_centre"].notna()]
        q = (*_ball(asked["q_centre"].tolist(), asked["q_radius"].tolist()), int(asked["worst"].min())) if len(asked) else (None, None, None)
        out = pd.DataFrame([(int(pdf["dim"].iloc[0]), int(pdf["branch"].iloc[0]), centre, radius, *q)], columns=["dim", "branch", "centre", "radius", "q_centre", "q_radius", "worst"], dtype=object)
        return out.astype({"radius": "Float64", "q_radius": "Float64", "worst": "Int64"})

    roots = common.written(placed.groupBy("dim", "branch").applyInPandas(root, "dim int, branch int, centre binary, radius double, q_centre binary, q_radius double, worst long"), "roots")
    wide = roots.select("dim", "branch", "centre", "radius").repartition(common.partitions(summaries.sparkSession), "branch")
    asking = roots.where("q_centre is not null").select("dim", F.col("branch").alias("q_branch"), "q_centre", "q_radius", "worst")
    left = common.written(_hopeful(wide.join(asking, "dim"), ["dim", "branch", "q_branch"], "dim int, branch int, q_branch int"), "branch_pairs")
    data = placed.select("dim", "branch", "block", "centre", "radius")
    asked = placed.where("q_centre is not null").select("dim", F.col("branch").alias("q_branch"), F.col("block").alias("other"), "q_centre", "q_radius", "worst")
    both = data.join(left, ["dim", "branch"]).join(asked, ["dim", "q_branch"]).where("block <> other")
    return _hopeful(both, ["block", "other", "centre", "radius"], "block long, other long, centre binary, radius double")


def top_k(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the K best for every row whose vec_id is divisible by EVERY."""
    rows = common.written(placed(common.written(quantised(df), "vectors"), block_rows), "blocks")
    own = common.written(rows.groupBy("block").applyInPandas(own_block, OWN), "own_block")
    first = own.where("query_id is not null").select("query_id", "vec_id", "score")
    pairs = block_pairs(own.where("query_id is null"))
    # a query's kth score in its own block, where it has K
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= K).select("query_id", "kth")
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("block").alias("other"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(int(LONG.min)))).join(pairs, "other").select("block", "query_id", "q", "kth", "centre", "radius")

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the queries for which the block's root leaves something better than their kth score."""
        for batch in batches:
            keep = []
            for k, (q, kth, centre, radius) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                v, (c, norm) = np.frombuffer(q, dtype="<i8").astype(np.float64), _centre(centre)
                if largest(v, float(np.sqrt(v @ v)), 0.0, c[None], np.array([norm]), np.array([radius]))[0] >= kth:
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(4)], names=["block", "query_id", "q", "kth"])

    asked = asked.mapInArrow(hopeful, "block long, query_id long, q binary, kth long")

    def others(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        dim = int(right["dim"].iloc[0])
        return Search(left["query_id"].to_numpy(), matrix(left["q"], dim), right["vec_id"].to_numpy(), matrix(right["v"], dim), left["kth"].to_numpy(dtype=np.int64)).frame()

    more = asked.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(others, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.union(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""
QUERIES = {"op2_topk": op2_topk}
ORACLES = {"op2_topk": SQL}
