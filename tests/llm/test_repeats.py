import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np

from tidemark.llm import repeats

W = repeats.WIDTH


def brute(texts):
    """texts: (doc_id, bytes) of each row; plain set of the windows of smaller documents; rows without an id stand apart."""
    seen, out = set(), {}
    for i in sorted({i for i, _ in texts if i is not None}):
        for t in {t for k, t in texts if k == i}:
            lost = bytearray(len(t))
            for k in range(len(t) - W + 1):
                if t[k : k + W] in seen:
                    lost[k : k + W] = b"\x01" * W
            rest = bytes(c for c, gone in zip(t, lost) if not gone)
            out[i, t] = (len(t), sum(lost), sum(a < b for a, b in pairwise([0, *lost])), rest)
        seen |= {t[k : k + W] for j, t in texts if j == i for k in range(len(t) - W + 1)}
    return out | {(None, t): (len(t), 0, 0, t) for i, t in texts if i is None}


def check(rows, docs):
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = brute(texts)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == Counter((i, *want[i, t][:3], hashlib.sha256(want[i, t][3]).hexdigest()) for i, t in texts)


def test_whole_table(spark, small):
    check(repeats.op3_suffix_dedup(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet"))


def test_edges(spark, edge, empty):
    check(repeats.remove_repeats(edge).collect(), edge)
    assert repeats.remove_repeats(empty).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(40, 120))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 4))]
        parts += [p[rng.randint(0, 20) :][: rng.randint(30, 120)] for p in rng.sample(passage, rng.randint(0, 3))]
        rng.shuffle(parts)
        texts.append("".join(parts))
    texts += ["a" * 200, "a" * 120, "ab" * 90, "b" + "a" * 60] + texts[:5] + ["x" * 49, "x" * 49, "x" * 50, "x" * 51]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(repeats.remove_repeats(docs).collect(), docs)


def test_suffix_array_and_intervals():
    rng = random.Random(6)
    for _ in range(60):
        contexts = ["".join(rng.choice("ab\0") for _ in range(rng.randint(W, W + 20))).encode() for _ in range(4)]
        contexts.append(contexts[0][:30] + contexts[1][30:])
        data = b"".join(contexts)
        ends = np.cumsum([len(c) for c in contexts])
        end = np.repeat(ends, [len(c) for c in contexts])
        starts = np.arange(len(data))
        order, prefix = repeats.suffix_array(np.frombuffer(data, np.uint8), end, starts)
        suffix = [data[i : end[i]] for i in order.tolist()]
        assert suffix == sorted(suffix)
        for x, y, p in zip(suffix, suffix[1:], prefix.tolist()):
            assert x[:p] == y[:p] and x[: p + 1] != y[: p + 1] or x == y == x[:p]


def test_stage_keeps_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = repeats.stage(spark, docs, small)
    assert out.columns == docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    result = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()}
    after = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(after[i] == before[i] for i, n in result.items() if n == 0)


def test_stage_on_edges(spark, edge, empty):
    """Every column comes through as it was, nulls, long ids and clashing names too."""
    out = repeats.stage(spark, edge, "")
    assert out.columns == edge.columns and repeats.stage(spark, empty, "").count() == 0
    want = brute([(r["doc_id"], (r["text"] or "").encode()) for r in edge.collect()])
    expected = Counter()
    for r in edge.collect():
        _, n, _, rest = want[r["doc_id"], (r["text"] or "").encode()]
        if n == 0 or rest.strip():
            text = rest.decode() if n else r["text"]
            expected[tuple({**r.asDict(), "text": text, "n_chars": text if r["doc_id"] is None else text and len(text)}.values())] += 1
    got = Counter(tuple({**r.asDict(), "n_chars": r["text"] if r["doc_id"] is None else r["text"] and len(r["text"])}.values()) for r in out.collect())
    assert got == expected


def test_long_ranks_are_paired_exactly():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
    assert (repeats._paired(a, b) == repeats._paired(a + 2**31, b) - 0).all()
