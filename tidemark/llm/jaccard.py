"""Documents linked by the Jaccard similarity of their word shingles: a blocked product of document by shingle.

Equal sets are one row of the incidence. Shingles are ordered by a sketched frequency, rare first; two sets at or
above the threshold share one among the first n - ceil(0.8 n) + 1 of each (the prefix). That part of the incidence is
dealt into blocks by shingle. The rows of one column whose sizes and positions allow the overlap that their sizes
demand form a row group. Row groups meet the rows' parities first: 2 to 4 bits a shingle, of which two sets that
differ in d shingles differ in d bits at most, so that few pairs below the threshold are left and none above it is
lost. What is left joins rows into parts that share no link with each other; each row is in one part.

Then the product itself: a part's incidence, columns in blocks, is multiplied with its transpose; overlap counts are
accumulated, and pairs whose count and remaining columns cannot reach the bound of their sizes are discarded after
each block. Texts are sent once, to their part. Parts give stars of linked rows; components join them.

A group or part of more than CHUNK rows is cut into chunks that share rows. Where that leaves it in several
components, the rows outside its largest one are compared with all its chunks of fitting size: every pair of rows in
two components has such a row. So a large group of near copies costs as much as its chunks, not as their square.

Defined results: a null or empty text, or one without words, has 0 shingles and is its own component; equal texts
link; rows of one doc_id are linked, each with its own number of shingles; a null doc_id has 0 shingles and a null
component, and stays in the stage; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

PERCENT = 80
#: The frequency sketch: a fixed number of counters (it only orders shingles, it decides nothing).
SKETCH_BITS, SKETCH_PARTS = 20, 16
FLUSH_BYTES = 24 << 20
BLOCK_SHINGLES = 2_000_000
#: Shingles of the small parts that one task multiplies, part by part.
PART_SHINGLES = 2_000_000
#: Rows of a group that one tile takes; larger groups are cut into chunks.
CHUNK = 512
#: Cells of the incidence that are multiplied at once.
SLAB_CELLS = 1 << 21
#: A large part's counts are repeated so often, so that its rows meet them in many tasks.
SALTS = 32


def required(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of these sizes reach the threshold."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]


def _signature(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common.mix(h + np.uint64(0x51)))))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    n = (ends - starts).astype(np.uint64)
    return common.mix((sums[ends] - sums[starts]) * np.uint64(0x9E3779B97F4A7C15) + n).view(np.int64)


def parities(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each set the parity of its members in each of w places, w a power of two from twice its size, 64 at least.

    Sets that differ in d members differ in at most d places; the halves of a wide one, added, give the narrow one.
    """
    n = np.diff(ends, prepend=0)
    width = np.array([max(64, 1 << int(2 * k - 1).bit_length()) if k else 0 for k in n.tolist()], dtype=np.int64)
    end = np.cumsum(width)
    at = np.repeat(end - width, n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    bits = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    np.add.at(bits, at, np.uint8(1))
    raw = np.packbits(bits & 1, bitorder="little").tobytes()
    return [raw[(e - w) >> 3 : e >> 3] for w, e in zip(width.tolist(), end.tolist(), strict=True)]


DESCRIBED = "doc_id long, n long, sig long, parity binary, part int, counts binary"


def describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, sig, parity) and, from each task, its part of the frequency sketch (part, counts)."""
    width = 1 << SKETCH_BITS
    names = [f.split()[0] for f in DESCRIBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width, dtype=np.uint32)
        for batch in batches:
            texts = _texts(batch, 1)
            n, sig, parity = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for a, b in common.batches(texts):
                h, ends = shingles.sets(texts[a:b])
                sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=width).astype(np.uint32)
                n.append(np.diff(ends, prepend=0))
                sig.append(_signature(h, ends))
                parity += parities(h, ends)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(sig)), pa.array(parity, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        size = width // SKETCH_PARTS
        parts = [(k, sketch[k * size : (k + 1) * size]) for k in range(SKETCH_PARTS)]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(parts), pa.binary()), pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, DESCRIBED)


def sketch_of(described: DataFrame) -> np.ndarray:
    """The summed sketch, of fixed size: 2^SKETCH_BITS counters."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for x in pdf["counts"])
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    size = (1 << SKETCH_BITS) // SKETCH_PARTS
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in described.where("part is not null").select("part", "counts").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


def prefixes(docs: DataFrame, sketch: np.ndarray, blocks: int) -> DataFrame:
    """(block, h, sig, n, place): the prefix incidence, dealt by shingle; equal sets of a task appear once.

    place: how far into its set a shingle stands, in 256ths, rounded down.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            block = (h % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            columns, block = [x[order] for x in (h, *rest)], block[order]
            cut = np.searchsorted(block, np.arange(blocks + 1))
            rows = [(k, *(x[a:b].tobytes() for x in columns)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 5))], names=["block", "h", "sig", "n", "place"])

        for batch in batches:
            texts = _texts(batch, 0)
            for a, b in common.batches(texts):
                h, ends = shingles.sets(texts[a:b])
                if not len(h):
                    continue
                sig = _signature(h, ends)
                n = np.diff(ends, prepend=0)
                new = np.zeros(len(sig), dtype=bool)
                for i, s in enumerate(sig.tolist()):
                    if n[i] and s not in seen:
                        seen.add(s)
                        new[i] = True
                owner = np.repeat(np.arange(len(n)), n)
                rank = counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | common.mix(h.copy()) >> np.uint64(32)
                order = np.lexsort((h, rank, owner))
                place = np.arange(len(h)) - np.repeat(ends - n, n)
                keep = (place < prefix_length(n)[owner]) & new[owner]
                size_of = n[owner[keep]]
                held.append((h[order][keep], sig[owner[keep]], size_of.astype(np.uint32), (256 * place[keep] // size_of).astype(np.uint8)))
                size += sum(map(len, texts[a:b]))
                if size > FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "block int, h binary, sig binary, n binary, place binary")


def _runs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where runs of one shingle begin whose neighbours' sizes allow the threshold; and the end."""
    apart = np.ones(len(h) + 1, dtype=bool)
    apart[1:-1] = (h[1:] != h[:-1]) | (100 * n[:-1] < PERCENT * n[1:])
    return np.flatnonzero(apart)


def row_groups(h: np.ndarray, sig: np.ndarray, n: np.ndarray, chunk: int = CHUNK, place: np.ndarray | None = None) -> Iterator[tuple[int | None, int, int, int, np.ndarray]]:
    """(chain, place, low, high, members): the sets (as sig) that share a shingle and whose sizes may reach the threshold.

    At the first shingle that two sets share, what either has left from there on bounds the overlap: a row goes where
    that is too little for the smallest size that its run allows. A group of more than `chunk` sets is a chain, named
    by its members; each of its parts holds the next one's first set.
    """
    order = np.lexsort((sig, n, h))
    h, sig, n = h[order], sig[order], n[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])
    h, sig, n = h[fresh], sig[fresh], n[fresh]
    if place is not None:
        at = _runs(h, n)
        least = np.maximum(np.repeat(n[at[:-1]], np.diff(at)), (PERCENT * n + 99) // 100)
        left = n - n * place[order][fresh].astype(np.int64) // 256
        stays = left >= required(n, least)
        h, sig, n = h[stays], sig[stays], n[stays]
    at = _runs(h, n)
    long = np.flatnonzero(np.diff(at) > 1)
    for a, b in zip(at[long].tolist(), at[long + 1].tolist(), strict=True):
        if b - a <= chunk:
            yield None, 0, int(n[a]), int(n[b - 1]), sig[a:b]
            continue
        chain = int(_signature(sig[a:b].view(np.uint64), np.array([b - a]))[0])
        for k, p in enumerate(range(a, b, chunk)):
            q = min(p + chunk + 1, b)
            yield chain, k, int(n[p]), int(n[q - 1]), sig[p:q]


GROUPS = "chain long, place int, low long, high long, members array<long>"


def groups_of(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """gid, chain, place, low, high, members: the distinct row groups of all blocks."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, sig, n, place = (np.concatenate([np.frombuffer(x, dtype=t) for x in pdf[c]]) for c, t in (("h", np.uint64), ("sig", np.int64), ("n", np.uint32), ("place", np.uint8)))
        out = {(chain, k, tuple(np.sort(g).tolist())): (low, high) for chain, k, low, high, g in row_groups(h, sig, n.astype(np.int64), chunk, place)}
        return pd.DataFrame({
            "chain": pd.Series([k[0] for k in out], dtype="Int64"), "place": pd.Series([k[1] for k in out], dtype="int32"),
            "low": pd.Series([v[0] for v in out.values()], dtype="int64"), "high": pd.Series([v[1] for v in out.values()], dtype="int64"),
            "members": pd.Series([list(k[2]) for k in out], dtype=object),
        })

    found = entries.groupBy("block").applyInPandas(run, GROUPS)
    return found.withColumn("gid", F.xxhash64("chain", "place", "members")).dropDuplicates(["gid"])


def unsettled(groups: DataFrame, roots: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """tile, members, roots: the comparisons that chains in several components still need.

    The rows outside a chain's largest component, gathered in order of size, meet all its chunks of fitting size.
    """
    chains = groups.where("chain is not null").select("chain", "place", "low", "high", "members")
    row = chains.select("chain", "place", "low", "high", F.explode("members").alias("sig")).join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    counts = row.groupBy("chain", "root").agg(F.count("*").alias("rows"))
    lead = counts.groupBy("chain").agg(F.max_by("root", F.struct("rows", "root")).alias("lead"), F.count("*").alias("parts")).where("parts > 1").select("chain", "lead")
    open_ = common.written(row.join(lead, "chain").groupBy("chain", "place", "low", "high").agg(
        F.collect_list(F.struct("sig", "root")).alias("all"), F.collect_list(F.when(F.col("root") != F.col("lead"), F.struct("sig", "root"))).alias("rest")), "open_chains")
    before = Window.partitionBy("chain").orderBy("low", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = open_.where(F.size("rest") > 0).select("chain", "place", "low", "high", "rest")
    rest = rest.withColumn("bin", F.floor(F.coalesce(F.sum(F.size("rest")).over(before), F.lit(0)) / chunk))
    rest = rest.groupBy("chain", "bin").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.flatten(F.collect_list("rest")).alias("rest"))
    fits = (100 * F.col("most") >= PERCENT * F.col("low")) & (100 * F.col("high") >= PERCENT * F.col("least"))
    both = rest.join(open_.select("chain", "low", "high", "all"), "chain").where(fits).select(F.array_sort(F.array_union("rest", "all")).alias("m"))
    both = both.select(F.col("m.sig").alias("members"), F.col("m.root").alias("roots")).withColumn("gid", F.xxhash64("members")).dropDuplicates(["gid"])
    return both.select(F.xxhash64("gid").alias("tile"), "members", "roots")


class Forest:
    """Components of the rows 0 to n - 1; the smallest row names each."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        self.up[max(a, b)] = min(a, b)


class Parities:
    """Rows (sizes and parities) of a tile; near() says with which others a row may reach the threshold."""

    def __init__(self, n: np.ndarray, raw: list[bytes]) -> None:
        self.n = n
        self.width = np.array([len(x) >> 3 for x in raw], dtype=np.int64)
        self.slot = np.zeros(len(n), dtype=np.int64)
        self.words: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.slot[at] = np.arange(len(at))
            self.words[w] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), dtype="<u8").reshape(-1, w)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the pairs (x, y) may reach the threshold."""
        swap = self.width[x] < self.width[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        out = 100 * np.minimum(self.n[x], self.n[y]) >= PERCENT * np.maximum(self.n[x], self.n[y])
        most = self.n[x] + self.n[y] - 2 * required(self.n[x], self.n[y])
        for w in np.unique(self.width[x[out]]).tolist():
            for v in (w, w // 2):
                at = np.flatnonzero(out & (self.width[x] == w) & (self.width[y] == v))
                step = max(1, SLAB_CELLS // w)
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    p = self.words[w][self.slot[x[part]]]
                    if v != w:
                        p = p[:, :v] ^ p[:, v:]
                    q = self.words[v][self.slot[y[part]]]
                    out[part] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= most[part]
        return out


def parity_links(groups: list[np.ndarray], rows: Parities, forest: Forest) -> None:
    """Joins the rows of each group that may be linked. Small groups are tested pair by pair, all at once; in large
    ones each row, in order of size, is tested with the smaller ones that it is not yet joined with."""
    small = [g for g in groups if len(g) <= 16]
    pairs = [np.empty((0, 2), dtype=np.int64)]
    for m in {len(g) for g in small}:
        at = np.array([g for g in small if len(g) == m])
        i, j = np.triu_indices(m, 1)
        pairs.append(np.stack((at[:, i].ravel(), at[:, j].ravel()), axis=1))
    both = np.concatenate(pairs)
    both = np.unique(np.sort(both, axis=1), axis=0)
    for a, b in both[rows.near(both[:, 0], both[:, 1])].tolist():
        forest.join(a, b)
    for g in groups:
        if len(g) <= 16:
            continue
        g = g[np.argsort(rows.n[g], kind="stable")]
        size = rows.n[g]
        low = np.searchsorted(size, -(-PERCENT * size // 100))
        for k in range(1, len(g)):
            mine = forest.find(int(g[k]))
            before = g[low[k] : k]
            before = before[np.array([forest.find(x) for x in before.tolist()], dtype=np.int64) != mine] if len(before) else before
            for x in before[rows.near(np.full(len(before), g[k]), before)].tolist():
                forest.join(x, int(g[k]))


def overlaps(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The overlap counts of all pairs of rows, as far as needed: the incidence (h, row) times its transpose.

    Columns are taken in blocks; a block of a few columns of one row each is skipped, since it adds to no pair. After
    each block the pairs are discarded that cannot reach the bound of their sizes; without others it ends.
    """
    m = len(n)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    held = np.diff(np.append(edge, len(h)))
    column = np.repeat(np.arange(len(edge)), held)
    several = held[column] > 1
    row, column = row[several], column[several]
    column = np.cumsum(np.diff(column, prepend=-1) != 0) - 1
    total = int(column[-1]) + 1 if len(column) else 0
    kind = np.float32 if n.max() < 1 << 24 else np.float64
    counts = np.zeros((m, m), dtype=kind)
    left = np.bincount(row, minlength=m)
    need = required(n[:, None], n[None, :])
    np.fill_diagonal(need, np.iinfo(np.int64).max)
    width = max(1, SLAB_CELLS // m)
    for k in range(0, total, width):
        a, b = np.searchsorted(column, [k, k + width])
        slab = np.zeros((m, min(width, total - k)), dtype=kind)
        slab[row[a:b], column[a:b] - k] = 1
        counts += slab @ slab.T
        left = left - np.bincount(row[a:b], minlength=m)
        if not (counts + np.minimum(left[:, None], left[None, :]) >= need).any():
            break
    return counts


def product_links(groups: list[np.ndarray], h: np.ndarray, ends: np.ndarray, forest: Forest) -> None:
    """Joins the linked rows of each group by its product."""
    n = np.diff(ends, prepend=0)
    for g in groups:
        size = n[g]
        row = np.repeat(np.arange(len(g)), size)
        begin = (ends - n)[g]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        i, j = np.nonzero(np.triu(overlaps(h[at], row, size) >= required(size[:, None], size[None, :]), 1))
        for a, b in zip(g[i].tolist(), g[j].tolist(), strict=True):
            forest.join(a, b)


def _star(sig: np.ndarray, forest: Forest) -> pd.DataFrame:
    root = np.array([forest.find(x) for x in range(len(sig))], dtype=np.int64)
    moved = np.flatnonzero(root != np.arange(len(sig)))
    return pd.DataFrame({"a": sig[moved], "b": sig[root[moved]]}, dtype="int64")


def _start(left: pd.DataFrame, sig: np.ndarray) -> tuple[list[np.ndarray], Forest]:
    """The groups of a tile as row numbers (sig is sorted and holds all members), and what is known to be joined."""
    forest, groups = Forest(len(sig)), []
    for g, known in zip(left["members"], left["roots"], strict=True):
        at = np.searchsorted(sig, np.asarray(g, dtype=np.int64))
        groups.append(at)
        if known is not None:
            _, first, which = np.unique(np.asarray(known, dtype=np.int64), return_index=True, return_inverse=True)
            for x, y in zip(at.tolist(), at[first[which]].tolist(), strict=True):
                forest.join(x, y)
    return groups, forest


def parity_tiles(tiles: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): stars of the rows of each tile (tile, members, roots) whose parities leave a link possible."""
    held = tiles.select(F.col("tile").alias("at"), F.explode("members").alias("sig")).distinct().join(reps.select("sig", "n", "parity"), "sig").dropDuplicates(["at", "sig"])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("sig", ignore_index=True)
        sig = right["sig"].to_numpy(dtype=np.int64)
        groups, forest = _start(left, sig)
        if len(sig):
            parity_links(groups, Parities(right["n"].to_numpy(dtype=np.int64), right["parity"].tolist()), forest)
        return _star(sig, forest)

    return tiles.groupBy("tile").cogroup(held.groupBy("at")).applyInPandas(run, "a long, b long")


def product_tiles(tiles: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): stars of the linked rows of each tile (tile, members, roots), from their documents' texts."""
    wanted = tiles.select("tile", F.explode("members").alias("sig")).distinct().join(reps.select("sig", "rep"), "sig")
    wanted = wanted.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("tile").alias("tiles"))
    held = docs.select("doc_id", "text").join(wanted, "doc_id").select(F.explode("tiles").alias("at"), "text")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        members = np.unique(np.concatenate([np.asarray(g, dtype=np.int64) for g in left["members"]])) if len(left) else np.empty(0, np.int64)
        h, ends = shingles.sets([(t or "").encode("utf-8", "surrogatepass") for t in right["text"]])
        n, sig = np.diff(ends, prepend=0), _signature(h, ends)
        # rows of one doc_id may differ: only the sets that were named count, each once
        name, first = np.unique(sig, return_index=True)
        first = first[np.isin(name, members)]
        size = n[first]
        at = np.repeat((ends - n)[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if len(first) != len(members):
            raise ValueError("a tile misses texts")
        groups, forest = _start(left, members)
        product_links(groups, h[at], np.cumsum(size), forest)
        return _star(members, forest)

    return tiles.groupBy("tile").cogroup(held.groupBy("at")).applyInPandas(run, "a long, b long")


def spanning(groups: DataFrame, compare: Callable[[DataFrame], DataFrame], tile: DataFrame, chunk: int, name: str) -> DataFrame:
    """(a, b): edges of the components that `compare` finds in groups; tile: gid and tile of the groups."""
    dealt = common.written(groups.join(tile, "gid").select("tile", "members", F.lit(None).cast("array<long>").alias("roots")), f"{name}_tiles")
    found = common.written(compare(dealt), name)
    if groups.where("chain is not null").isEmpty():
        return found
    joined = components(found)
    more = common.written(unsettled(groups, joined, chunk), f"{name}_open_tiles")
    if more.isEmpty():
        return found
    return found.union(common.written(compare(more), f"{name}_more"))


def parts_of(joined: DataFrame, reps: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The parts (gid, chain, place, low, high, members) of rows that may be linked, and their tiles (gid, tile).

    joined: node, root. Small parts share a tile. A larger one is a chain of chunks by size band and hash of the row;
    each chunk also holds the first rows of its band and of the next one.
    """
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / PERCENT)))).cast("int")
    row = common.written(joined.join(reps.select(F.col("sig").alias("node"), "n"), "node").select("root", F.col("node").alias("sig"), "n", band.alias("band")), "part_rows")
    bands = common.written(row.groupBy("root", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.min(F.struct("sig", "n")).alias("first")), "part_bands")
    weight = F.greatest(F.sum("rows") / chunk, F.sum("size") / F.lit(PART_SHINGLES))
    large = bands.groupBy("root").agg(weight.alias("weight")).where("weight > 1").select("root")
    many = bands.join(large, "root").withColumn("chunks", F.ceil(F.greatest(F.col("rows") / chunk, F.col("size") / F.lit(PART_SHINGLES))).cast("int"))
    many = common.written(many, "large_parts")
    salt = F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")
    keyed = many.select("root", "band", "chunks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = row.withColumn("salt", salt).join(keyed, ["root", "band", "salt"]).select("root", "band", F.pmod(F.xxhash64("sig", F.lit(1)), F.col("chunks")).cast("int").alias("k"), "sig", "n")
    lead = many.select("root", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "first.sig", "first.n")
    lead = lead.join(many.select("root", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")), ["root", "band"]).select("root", "band", "k", "sig", "n")
    chunks = placed.union(lead).groupBy("root", "band", "k").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.array_sort(F.collect_set("sig")).alias("members"))
    chunks = chunks.select(F.xxhash64("root", "band", "k").alias("gid"), F.col("root").alias("chain"), F.hash("band", "k").alias("place"), "low", "high", "members")
    small = row.join(large, "root", "left_anti").groupBy("root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("size"), F.array_sort(F.collect_set("sig")).alias("members"))
    small = common.written(small, "small_parts")
    total = small.agg(F.sum("size")).first()[0] or 0
    buckets = common.bucket_count(total, PART_SHINGLES, 4)
    groups = common.written(chunks.union(small.select(F.xxhash64("root").alias("gid"), F.lit(None).cast("long"), F.lit(0), "low", "high", "members")), "parts")
    tile = F.when(F.col("chain").isNull(), F.pmod("gid", F.lit(buckets))).otherwise(F.xxhash64("gid"))
    return groups, groups.select("gid", tile.alias("tile"))


def links(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """nodes (doc_id, n, sig, rep) and links (a, b) between representatives that span every component."""
    described = common.written(describe(docs), "shingle_sets")
    sizes = described.where("part is null").select("doc_id", "n", "sig", "parity")
    reps = common.written(sizes.where("n > 0").groupBy("n", "sig").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity")), "shingle_reps")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    entries = prefixes(docs, sketch_of(described), common.bucket_count(total, BLOCK_SHINGLES, 4))
    groups = common.written(groups_of(entries, chunk), "row_groups")
    # small groups with a common row mostly share a tile; a chunk of a chain is a tile of its own
    short = groups.where("chain is null")
    member = short.select("gid", F.explode("members").alias("sig"))
    first = member.join(short.select("gid", F.array_min("members").alias("low")), "gid").groupBy("sig").agg(F.min("low").alias("label"))
    tile = member.join(first, "sig").groupBy("gid").agg(F.pmod(F.min("label"), F.lit(common.bucket_count(total, BLOCK_SHINGLES, 4))).alias("tile"))
    tile = tile.union(groups.where("chain is not null").select("gid", F.xxhash64("gid")))
    possible = spanning(groups, lambda t: parity_tiles(t, reps), tile, chunk, "possible")
    parts, part_tile = parts_of(components(possible), reps, chunk)
    found = spanning(parts, lambda t: product_tiles(t, reps, docs), part_tile, chunk, "links")
    name = reps.select("sig", "rep")
    ends = found.join(name.select(F.col("sig").alias("a"), F.col("rep").alias("x")), "a").join(name.select(F.col("sig").alias("b"), F.col("rep").alias("y")), "b")
    nodes = sizes.drop("parity").join(reps.drop("parity"), ["n", "sig"], "left")
    # rows of one doc_id that differ are linked by it
    differ = sizes.groupBy("doc_id").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high").select("doc_id")
    own = nodes.where("rep is not null").join(differ, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return nodes, ends.select(F.col("x").alias("a"), F.col("y").alias("b")).union(own)


def cluster(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; as in SQL, 0 and null where doc_id is null."""
    nodes, edges = links(docs.where("doc_id is not null"), chunk)
    roots = components(edges)
    out = nodes.withColumn("rep", F.coalesce("rep", "doc_id")).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))
    return out.union(docs.where("doc_id is null").select("doc_id", F.lit(0).cast(out.schema["n_shingles"].dataType), "doc_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with all columns; those of null doc_id all stay."""
    stay = cluster(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").union(docs.where("doc_id is null").select("doc_id", *(c for c in docs.columns if c != "doc_id")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^$', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS node, x AS seen FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLES = {"op6_ngram_jaccard": SQL}
