"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding by table lookup.

A leaf holds (rank, position) of the pair that begins there; the root is thus the leftmost pair of lowest rank. A
merge changes three leaves, each a logarithmic update, until the root says that nothing merges. Short pieces are
worked through many at once, one row of trees for each; longer ones have a tree of their own.

Defined results: a null text is empty and has no ids; repeated rows are encoded each; special tokens that stand in
a text become their ids; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, pretoken

MODEL = "byte_bpe_50k.json"
NONE = 1 << 40
#: The longest pieces, in bytes, that are worked through many at once, and how many bytes of them.
SHORT, ROWS_BYTES = 64, 1 << 19


def _rows(v: pretoken.Vocabulary, words: list[bytes], leaves: int) -> list[bytes]:
    """Merges words of at most `leaves` (a power of two) bytes, all at once."""
    w = len(words)
    bits = leaves.bit_length()
    size = np.array([len(x) for x in words])
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    column = np.arange(leaves)
    live = column < size[:, None]
    sym = np.full((w, leaves + 1), -1, dtype=np.int64)
    sym[:, :leaves][live] = v.of_byte[flat]
    after = np.tile(np.minimum(np.arange(1, leaves + 2), leaves), (w, 1))
    before = np.tile(np.arange(-1, leaves), (w, 1))
    tree = np.full((w, 2 * leaves), NONE << bits, dtype=np.int64)
    ranks = v.rank(sym[:, :leaves], sym[:, 1:], NONE)
    tree[:, leaves:] = np.where(ranks < NONE, ranks << bits | column, NONE << bits)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + leaves
        tree[rows, node] = value
        while leaves > 1 and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] >> bits < NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & ((1 << bits) - 1)
        gone = after[rows, at]
        new = after[rows, gone]
        sym[rows, at] = v.made[root >> bits]
        sym[rows, gone] = -1
        after[rows, at] = new
        before[rows, new] = at
        rank = v.rank(sym[rows, at], sym[rows, new], NONE)
        put(rows, gone, np.full(len(rows), NONE << bits))
        put(rows, at, np.where(rank < NONE, rank << bits | at, NONE << bits))
        p = before[rows, at]
        inner = p >= 0
        if inner.any():
            r, q, a = rows[inner], p[inner], at[inner]
            rank = v.rank(sym[r, q], sym[r, a], NONE)
            put(r, q, np.where(rank < NONE, rank << bits | q, NONE << bits))
        rows = rows[tree[rows, 1] >> bits < NONE]
    kept = sym[:, :leaves] >= 0
    ids = sym[:, :leaves][kept].astype("<u4").tobytes()
    ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _long(v: pretoken.Vocabulary, word: bytes, pair: dict[int, int]) -> bytes:
    """The same merges for one piece of any length, in n log n steps."""
    n = len(word)
    leaves = 1 << max(1, (n - 1).bit_length())
    sym = v.of_byte[np.frombuffer(word, dtype=np.uint8)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = np.full(2 * leaves, NONE * leaves, dtype=np.int64)
    ranks = v.rank(sym[:-1], sym[1:], NONE)
    tree[leaves : leaves + n - 1] = np.where(ranks < NONE, ranks * leaves + np.arange(n - 1), NONE * leaves)
    width = leaves
    while width > 1:
        width >>= 1
        tree[width : 2 * width] = np.minimum(tree[2 * width : 4 * width : 2], tree[2 * width + 1 : 4 * width : 2])
    tree, sym, made, none = tree.tolist(), sym.tolist(), v.made.tolist(), NONE * leaves

    def put(leaf: int, value: int) -> None:
        node = leaf + leaves
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a < b else b
            if tree[node] == best:
                break
            tree[node] = best

    while tree[1] < none:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        new = after[gone]
        sym[at], sym[gone], after[at] = made[rank], -1, new
        put(gone, none)
        if new < n:
            before[new] = at
            rank = pair.get(sym[at] * v.size + sym[new])
            put(at, none if rank is None else rank * leaves + at)
        else:
            put(at, none)
        p = before[at]
        if p >= 0:
            rank = pair.get(sym[p] * v.size + sym[at])
            put(p, none if rank is None else rank * leaves + p)
    return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()


@cache
def _pairs(path: str) -> dict[int, int]:
    v = pretoken.vocabulary(path)
    return dict(zip(v.keys.tolist(), v.ranks.tolist(), strict=True))


def encode_pieces(path: str, words: list[str]) -> list[bytes]:
    """The ids of each piece as little-endian uint32 bytes, by the segment tree."""
    v = pretoken.vocabulary(path)
    raw = [w.encode("utf-8") for w in words]
    out: list[bytes] = [b""] * len(raw)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(raw):
        if len(x) > SHORT:
            out[i] = _long(v, x, _pairs(path))
        elif x:
            groups.setdefault(1 << max(1, (len(x) - 1).bit_length()), []).append(i)
    for leaves, members in groups.items():
        step = max(1, ROWS_BYTES // leaves)
        for k in range(0, len(members), step):
            part = members[k : k + step]
            for i, ids in zip(part, _rows(v, [raw[i] for i in part], leaves), strict=True):
                out[i] = ids
    return out


@cache
def encoder(path: str) -> pretoken.Encoder:
    return pretoken.Encoder(pretoken.vocabulary(path).special, lambda words: encode_pieces(path, words))


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded); one narrow pass over the texts."""
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, v = encoder(path), pretoken.vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for ids in enc.texts(texts):
                decoded = v.decode(ids)
                row = (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                rows.append((*row, ids.tolist(), decoded) if with_ids else row)
            names = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")[: 5 if with_ids else 3]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names)))], names=["doc_id", *names])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLES: dict[str, str] = {}
