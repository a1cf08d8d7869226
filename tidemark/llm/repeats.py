"""Exact removal of repeated passages: enhanced suffix arrays over the places that can repeat, and their intervals.

Each window of WIDTH bytes has an anchor, its leftmost least-hashed GRAM-byte substring; equal windows have equal
anchors. Anchors that occur in one document only cannot take part in a repeat. The others' contexts (all windows
of one anchor, laid end to end) are dealt by anchor; equal contexts are kept once with all their occurrences. In
each part a suffix array with its common-prefix array is built over the contexts, and a stack scan of its interval
tree yields the intervals of depth WIDTH and more. Those whose left neighbours differ (or lie outside the context)
are the maximal repeat groups, with every occurrence; an occurrence loses the group's bytes if a document of
smaller doc_id holds another one. Ranges go back to the documents and are united there.

Work is dealt in blocks of documents of about BLOCK_BYTES; the texts are shuffled once and that shuffle is reused.
A part gets each context once from a block, with the smallest doc_id that the block has for it, and answers with the
intervals' places; the occurrences themselves only go back to their block, so that a passage of a third of all
documents is as many rows in its part as there are blocks. Equal texts are settled beforehand: all but the first lose
everything, if long enough.

Defined results: a null text is empty; texts shorter than WIDTH bytes lose nothing; rows of one doc_id lose nothing to
each other and are judged each; a null doc_id has no order: such rows neither lose nor take anything; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH, GRAM = 50, 20
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: Bytes of contexts for one suffix array; anchors are never split.
ARRAY_BYTES = 1 << 21
COPIES, HASHES, PLACES, FOUND = range(4)
#: What blocks are told: the names of copies; repeated anchors; where the contexts of a part lie; what they lose.
CONTROL = "block int, kind int, part int, names array<long>, data binary, docs binary, starts binary"
_CONTROL = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("names", pa.list_(pa.int64())), ("data", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])


class Chunk:
    """Texts laid end to end with their windows' anchors."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        n = len(self.data)
        self.at = np.empty(0, dtype=np.int64)  # the valid windows
        self.anchor = np.empty(0, dtype=np.int64)
        self.hash = np.empty(0, dtype=np.uint64)
        self.owner = np.empty(0, dtype=np.int64)
        if n < WIDTH:
            return
        begin = np.arange(n - GRAM + 1)
        h = common.Slices(self.data).hashes(begin, begin + GRAM) & ~np.uint64(1)
        low = np.uint64((1 << max(24, n.bit_length())) - 1)
        least = (h & ~low) | begin.astype(np.uint64)
        span, want = 1, WIDTH - GRAM + 1
        while span * 2 <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if want > span:
            least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
        owner = np.repeat(np.arange(len(texts)), self.size)
        self.at = np.flatnonzero(owner[: n - WIDTH + 1] == owner[WIDTH - 1 :])
        self.anchor = (least[self.at] & low).astype(np.int64)
        self.hash = h[self.anchor]
        self.owner = owner[self.at]


def _rows(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return texts["doc_id"].to_numpy(), texts["name"].to_numpy(), [x or b"" for x in texts["text"].to_pylist()]


def _told(control: pa.Table, kind: int) -> pa.Table:
    return control.filter(pa.compute.equal(control["kind"], kind))


def _copies(control: pa.Table) -> set[int]:
    return {i for names in _told(control, COPIES)["names"].to_pylist() for i in names}


def _distinct(doc: np.ndarray, texts: list[bytes]) -> dict[tuple[int, bytes], int]:
    """Each different text of each document, in order, with its offset among the texts of its document laid end to end."""
    out, at = {}, {}
    for i, t in sorted(set(zip(doc.tolist(), texts, strict=True))):
        out[i, t] = at.get(i, 0)
        at[i] = out[i, t] + len(t)
    return out


def _chunks(texts: pa.Table, control: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, Chunk]]:
    """(doc_ids, offsets, chunk) of the documents of a block that are not copies of another."""
    copies = _copies(control)
    doc, name, values = _rows(texts)
    stay = [k for k, x in enumerate(name.tolist()) if x not in copies]
    held = _distinct(doc[stay], [values[k] for k in stay])
    ids, offset, values = np.array([i for i, _ in held], dtype=np.int64), np.array(list(held.values()), dtype=np.int64), [t for _, t in held]
    for a, b in common.batches(values):
        yield ids[a:b], offset[a:b], Chunk(values[a:b])


def block_anchors(texts: pa.Table, control: pa.Table, parts: int) -> pa.Table:
    """The distinct anchors of a block by part; the lowest bit says that two documents of the block hold it."""
    pairs = [np.empty((0, 2), dtype=np.uint64)]
    for ids, _, c in _chunks(texts, control):
        first = np.flatnonzero(np.diff(c.anchor, prepend=-1))
        pairs.append(np.stack((c.hash[first], ids[c.owner[first]].astype(np.uint64)), axis=1))
    both = np.concatenate(pairs)
    order = np.lexsort((both[:, 1], both[:, 0]))
    h, doc = both[order, 0], both[order, 1]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    other = np.zeros(len(h), dtype=bool)
    other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    out = h[at] | (np.logical_or.reduceat(other, at).astype(np.uint64) if len(at) else np.empty(0, np.uint64))
    part = (out >> np.uint64(1)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    out, cut = out[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    block = texts["block"][0].as_py() if len(texts) else 0
    rows = [(k, block, out[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "block", "data"])


def repeated_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, those of its anchors that a second document holds, somewhere."""
    held = [np.frombuffer(x, dtype=np.uint64) for x in pdf["data"]]
    h = np.sort(np.concatenate(held))
    again = np.unique(np.concatenate((h[1:][h[1:] >> np.uint64(1) == h[:-1] >> np.uint64(1)], h[h & np.uint64(1) == 1])) & ~np.uint64(1))
    rows = []
    for block, x in zip(pdf["block"], held, strict=True):
        x = x & ~np.uint64(1)  # sorted, as sent
        at = np.searchsorted(again, x)
        found = x[again[np.minimum(at, len(again) - 1)] == x] if len(again) else x[:0]
        if len(found):
            rows.append((block, HASHES, None, None, found.tobytes(), None, None))
    return _control(rows)


def _control(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([r[k] for r in rows], dtype="Int32" if f.type == pa.int32() else object) for k, f in enumerate(_CONTROL)})


CONTEXTS = "kind int, dest int, block int, anchors binary, lengths binary, bytes binary, least binary, which binary, docs binary, starts binary"
_CONTEXTS = [f.split() for f in CONTEXTS.split(", ")]


def block_contexts(texts: pa.Table, control: pa.Table, parts: int) -> pa.Table:
    """The contexts of a block's repeated anchors by part, each distinct one once with its least doc_id; and, for the
    block itself, where they all occur."""
    sent = [np.frombuffer(x, dtype=np.uint64) for x in _told(control, HASHES)["data"].to_pylist()]
    again = np.sort(np.concatenate(sent)) if sent else np.empty(0, np.uint64)
    places: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    anchors: dict[bytes, int] = {}
    if len(again):
        for ids, offset, c in _chunks(texts, control):
            if not len(c.at):
                continue
            run = np.flatnonzero((np.diff(c.anchor, prepend=-1) != 0) | (np.diff(c.at, prepend=-2) != 1))
            h = c.hash[run]
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            last = np.append(run[1:], len(c.at)) - 1
            keep = again[at] == h
            b, e, h, doc = c.at[run][keep], c.at[last][keep] + WIDTH, h[keep], c.owner[run][keep]
            raw, part = c.data.tobytes(), ((h >> np.uint64(1)) % np.uint64(parts)).tolist()
            for k, p, q, d, s, a in zip(part, b.tolist(), e.tolist(), ids[doc].tolist(), (b - c.start[doc] + offset[doc]).tolist(), h.tolist(), strict=True):
                x = raw[p:q]
                places.setdefault(k, {}).setdefault(x, []).append((d, s))
                anchors[x] = a
    block = texts["block"][0].as_py() if len(texts) else 0
    rows: list[tuple] = []
    for k, found in places.items():
        n = [len(v) for v in found.values()]
        where = np.array([p for v in found.values() for p in v], dtype=np.int64)
        least = np.array([min(v)[0] for v in found.values()], dtype=np.int64)
        rows.append((FOUND, k, block, np.array([anchors[x] for x in found], np.uint64).tobytes(), np.array([len(x) for x in found], np.uint16).tobytes(), b"".join(found), least.tobytes(), None, None, None))
        lengths = np.repeat(np.array([len(x) for x in found], np.uint16), n)
        rows.append((PLACES, block, k, None, lengths.tobytes(), None, np.repeat(least, n).tobytes(), np.repeat(np.arange(len(n)), n).astype(np.uint32).tobytes(), where[:, 0].tobytes(), where[:, 1].astype(np.uint32).tobytes()))
    return pa.table([pa.array([r[i] for r in rows], pa.int32() if t == "int" else pa.binary()) for i, (_, t) in enumerate(_CONTEXTS)], names=[n for n, _ in _CONTEXTS])


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The ranks of the pairs (first, second), from 0."""
    if len(first) and int(first.max()) < 2**31 and int(second.max()) < 2**31:
        return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(np.append(False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return out


def suffix_array(data: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in order and the common prefixes of neighbours; a suffix stops at end[its position].

    Prefix doubling: ranks of 8, 16, 32, ... bytes; common prefixes come from the same ranks, longest first.
    """
    n, longest = len(data), int((end[starts] - starts).max())
    room = end - np.arange(n)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64) + np.uint64(0)
    word = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | np.where(room > k, padded[k : n + k], np.uint64(0))
    # a suffix that stops within 8 bytes comes before one that goes on with zero bytes
    _, rank = np.unique(word, return_inverse=True)
    rank = rank.astype(np.int64) * 9 + np.minimum(room, 8)
    levels, span = [(8, rank)], 8
    while span < longest:
        next_rank = np.zeros(n, dtype=np.int64)
        next_rank[: n - span] = np.where(room[: n - span] > span, rank[span:] + 1, 0) if n > span else 0
        rank = _paired(rank, next_rank)
        span *= 2
        levels.append((span, rank))
    order = starts[np.argsort(rank[starts], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    common_prefix = np.zeros(len(a), dtype=np.int64)
    for span, r in reversed(levels):
        inside = (a < n) & (b < n)
        p, q = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = inside & (r[p] == r[q]) & (end[order[:-1]] - a >= span) & (end[order[1:]] - b >= span)
        for x in (a, b, common_prefix):
            x += same * span
    open_ = np.ones(len(a), dtype=bool)
    for _ in range(8):
        p, q = np.minimum(a, n - 1), np.minimum(b, n - 1)
        open_ &= (a < end[order[:-1]]) & (b < end[order[1:]]) & (data[p] == data[q])
        for x in (a, b, common_prefix):
            x += open_
    return order, common_prefix


def maximal_repeats(order: np.ndarray, prefix: np.ndarray, left: np.ndarray, least: int = WIDTH) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of depth `least` and more that is not always preceded by one symbol.

    left: the symbol before each suffix in order; a negative one differs from all others.
    """
    change = np.ones(len(order), dtype=bool)
    change[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    changes = np.cumsum(change)
    inner = np.flatnonzero(prefix >= least)
    if not len(inner):
        return
    breaks = np.flatnonzero(np.diff(inner) != 1)
    for a, b in zip(np.append(0, breaks + 1).tolist(), np.append(breaks, len(inner) - 1).tolist(), strict=True):
        low, high = int(inner[a]), int(inner[b])
        stack: list[tuple[int, int]] = []
        for k, depth in enumerate([*prefix[low : high + 1].tolist(), 0], low):
            first = k
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                if changes[k] > changes[first]:
                    yield d, first, k
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))


def part_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, what the contexts that it sent to this part lose; rows for the block itself only pass.

    data: for each context whether the block holds its first document; starts: (context, offset, depth) of the places
    that this document loses. Every other document loses the whole context: a leaf with all its occurrences.
    """
    if int(pdf["kind"].iloc[0]) == PLACES:
        return _control([(r.dest, PLACES, r.block, None, r.which + r.lengths + r.least, r.docs, r.starts) for r in pdf.itertuples(index=False)])
    number: dict[bytes, int] = {}
    contexts: list[bytes] = []
    anchors: list[int] = []
    first: list[int] = []
    sent = []
    for r in pdf.itertuples(index=False):
        lengths = np.frombuffer(r.lengths, np.uint16).astype(np.int64)
        ends, least = np.cumsum(lengths), np.frombuffer(r.least, np.int64)
        ids = np.empty(len(lengths), dtype=np.int64)
        for k, (p, q, a, d) in enumerate(zip((ends - lengths).tolist(), ends.tolist(), np.frombuffer(r.anchors, np.uint64).tolist(), least.tolist(), strict=True)):
            x = r.bytes[p:q]
            i = number.setdefault(x, len(contexts))
            if i == len(contexts):
                contexts.append(x)
                anchors.append(a)
                first.append(d)
            elif d < first[i]:
                first[i] = d
            ids[k] = i
        sent.append((int(r.block), ids, least))
    part = int(pdf["dest"].iloc[0])
    number.clear()
    size, least = np.array([len(x) for x in contexts], dtype=np.int64), np.array(first, dtype=np.int64)
    by_anchor = np.argsort(np.array(anchors, dtype=np.uint64), kind="stable")
    key = np.array(anchors, dtype=np.uint64)[by_anchor]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    batch: list[np.ndarray] = []
    held, out = 0, []
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(key)).tolist(), strict=True):
        if b - a > 1:
            batch.append(by_anchor[a:b])
            held += int(size[by_anchor[a:b]].sum())
        if batch and (held >= ARRAY_BYTES or b == len(key)):
            members = np.concatenate(batch)
            c, x, depth = repeat_places([contexts[i] for i in members.tolist()], least[members])
            out.append(np.stack((members[c], x, depth)))
            batch, held = [], 0
    places = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
    places = places[:, np.argsort(places[0], kind="stable")]
    cut = np.searchsorted(places[0], np.arange(len(contexts) + 1))
    rows = []
    for block, ids, mine in sent:
        holds = mine == least[ids]
        n = np.where(holds, cut[ids + 1] - cut[ids], 0)
        at = _spread(cut[ids], n)
        found = np.stack((np.repeat(np.arange(len(ids)), n), places[1, at], places[2, at]), axis=1).astype(np.uint32)
        rows.append((block, FOUND, part, None, holds.tobytes(), None, found.tobytes()))
    return _control(rows)


def lost_ranges(control: pa.Table) -> np.ndarray:
    """(document, begin, end) of what the documents of a block lose, from its places and what was found for them."""
    found = {r["part"]: r for r in _told(control, FOUND).to_pylist()}
    out = [np.empty((0, 3), dtype=np.int64)]
    for r in _told(control, PLACES).to_pylist():
        doc, start = np.frombuffer(r["docs"], np.int64), np.frombuffer(r["starts"], np.uint32).astype(np.int64)
        n = len(doc)
        which = np.frombuffer(r["data"], np.uint32, n).astype(np.int64)
        length = np.frombuffer(r["data"], np.uint16, n, 4 * n).astype(np.int64)
        least = np.frombuffer(r["data"][6 * n :], np.int64)
        answer = found[r["part"]]
        whole = (doc > least) | ~np.frombuffer(answer["data"], bool)[which]
        out.append(np.stack((doc, start, start + length), axis=1)[whole])
        places = np.frombuffer(answer["starts"], np.uint32).reshape(-1, 3).astype(np.int64)
        cut = np.searchsorted(places[:, 0], [which, which + 1])
        n = np.where(whole, 0, cut[1] - cut[0])
        at, row = _spread(cut[0], n), np.repeat(np.arange(len(doc)), n)
        begin = start[row] + places[at, 1]
        out.append(np.stack((doc[row], begin, begin + places[at, 2]), axis=1))
    return np.concatenate(out)


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def repeat_places(contexts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, depth) of the places that a maximal repeat group takes from a context's first document."""
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    size = np.array([len(x) for x in contexts], dtype=np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(contexts)), size)
    starts = _spread(ends - size, size - WIDTH + 1)
    order, prefix = suffix_array(data, ends[owner], starts)
    inside = order > (ends - size)[owner[order]]
    left = np.where(inside, data[np.maximum(order - 1, 0)].astype(np.int64), -1)
    docs = first[owner[order]]
    out = []
    for depth, a, b in maximal_repeats(order, prefix, left):
        held = docs[a : b + 1]
        lose = np.flatnonzero(held > held.min())
        if len(lose):
            out.append((order[a + lose], np.full(len(lose), depth)))
    at, depth = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
    return owner[at], at - (ends - size)[owner[at]], depth


def united(ranges: np.ndarray) -> np.ndarray:
    """Ranges (begin, end) made disjoint; touching ones become one."""
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack((ranges[at, 0], reach[np.append(at[1:], len(reach)) - 1]), axis=1)


def block_results(texts: pa.Table, control: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    """n_removed, n_spans and the bytes that stay of each row."""
    copies, lost = _copies(control), lost_ranges(control)
    lost = lost[np.argsort(lost[:, 0], kind="stable")]
    doc, name, values = _rows(texts)
    stay = [k for k, x in enumerate(name.tolist()) if x not in copies]
    offset = _distinct(doc[stay], [values[k] for k in stay])
    removed, spans, kept = [], [], []
    for i, x, text in zip(doc.tolist(), name.tolist(), values, strict=True):
        if x in copies:
            cuts = [[0, len(text)]] if len(text) >= WIDTH else []
        else:
            a, b = np.searchsorted(lost[:, 0], [i, i + 1])
            span = lost[a:b, 1:] - offset[i, text]
            span = span[(span[:, 0] >= 0) & (span[:, 0] < len(text))]
            cuts = united(span).tolist() if len(span) else []
        pieces, at = [], 0
        for p, q in cuts:
            pieces.append(text[at:p])
            at = q
        rest = b"".join((*pieces, text[at:]))
        removed.append(len(text) - len(rest))
        spans.append(len(cuts))
        kept.append(rest)
    return removed, spans, kept


def _judged(docs: DataFrame, carried: list[str], results, schema: str | T.StructType) -> DataFrame:
    """results(texts, control) over all blocks of the rows that have a doc_id; texts hold the carried columns too."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = (common.bucket_count(size, each, common.partitions(spark)) for each in (BLOCK_BYTES, PART_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    name = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    same = (F.xxhash64("text"), F.xxhash64(F.lit("second"), "text"), F.octet_length("text"))
    keys = docs.where("text is not null").select("doc_id", name.alias("name"), *(c.alias(f"k{i}") for i, c in enumerate(same)))
    firsts = keys.groupBy("k0", "k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = keys.join(firsts, ["k0", "k1", "k2"]).where("doc_id > first").select("doc_id", "name").distinct()
    copies = copies.groupBy(block.alias("block")).agg(F.collect_list("name").alias("names"))
    null = F.lit(None)
    copies = copies.select("block", F.lit(COPIES).alias("kind"), null.cast("int").alias("part"), "names", *(null.cast("binary").alias(c) for c in ("data", "docs", "starts")))
    copies = common.written(copies, "copies")
    texts = docs.select(block.alias("block"), "doc_id", name.alias("name"), F.col("text").cast("binary").alias("text"), *carried)

    def anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_anchors(left, right, parts)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_contexts(left, right, parts)

    found = texts.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(anchors, "part int, block int, data binary")
    again = found.groupBy("part").applyInPandas(repeated_anchors, CONTROL)
    dealt = texts.groupBy("block").cogroup(copies.union(again).groupBy("block")).applyInArrow(contexts, CONTEXTS)
    ranges = dealt.groupBy("kind", "dest").applyInPandas(part_ranges, CONTROL)
    return texts.groupBy("block").cogroup(copies.union(ranges).groupBy("block")).applyInArrow(results, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that stay) of every document."""
    def results(texts: pa.Table, control: pa.Table) -> pa.Table:
        removed, spans, kept = block_results(texts, control)
        size = [n + len(x) for n, x in zip(removed, kept, strict=True)]
        sha = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table([texts["doc_id"], pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    docs = docs.select("doc_id", "text")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    zero = F.lit(0).cast("long")
    apart = docs.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return _judged(docs, [], results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").union(apart)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeats; those of which nothing but white space is left go.

    A character whose bytes are cut goes with them. n_chars follows the text. The other columns travel with the text.
    """
    def results(texts: pa.Table, control: pa.Table) -> pa.Table:
        removed, _, kept = block_results(texts, control)
        text = [x if n else old for n, x, old in zip(removed, kept, texts["text"].to_pylist(), strict=True)]
        return pa.table([texts["_doc"], pa.array([n > 0 for n in removed], pa.bool_()), pa.array(text, pa.binary())], names=["_doc", "_cut", "_text"])

    packed = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("_doc"))
    done = _judged(packed, ["_doc"], results, T.StructType([packed.schema["_doc"], T.StructField("_cut", T.BooleanType()), T.StructField("_text", T.BinaryType())]))
    whole = F.col("_text").cast("string")
    cut = F.coalesce(F.call_function("try_validate_utf8", whole), F.regexp_replace(F.call_function("make_valid_utf8", whole), "\ufffd", ""))
    done = done.withColumn("_text", F.when(F.col("_cut"), cut).otherwise(whole)).where(~F.col("_cut") | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    out = done.select("_text", "_doc.*").withColumnRenamed("_text", "text").select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.union(docs.where("doc_id is null"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
