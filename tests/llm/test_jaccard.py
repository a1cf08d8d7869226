import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import jaccard
from tidemark.llm.components import components


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(map(tuple, [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w]))


def brute(rows):
    """(n_shingles, component) of each row (doc_id, text); rows of one doc_id are linked."""
    sets = [shingle_set(t) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(sets):
        for m in range(k):
            b = sets[m]
            x = len(a & b)
            if x and 100 * x >= 80 * (len(a) + len(b) - x) and None not in (rows[k][0], rows[m][0]):
                p, q = sorted((find(rows[k][0]), find(rows[m][0])))
                root[q] = p
    return [(0, None) if i is None else (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def check(rows, docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(map(tuple, rows)) == Counter((i, *w) for (i, _), w in zip(texts, brute(texts), strict=True))


def test_whole_table(spark, small):
    check(jaccard.op6_ngram_jaccard(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet"))


def test_edges(spark, edge, empty):
    check(jaccard.cluster(edge).collect(), edge)
    assert jaccard.cluster(empty).count() == 0


def near_copies(n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_copies_and_chunks(spark):
    texts = near_copies(60, 6, 1) + near_copies(40, 3, 2) + ["A b C", "a B c", "a b", " ", "q r s t u v", "Q R S T U V w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (8, jaccard.CHUNK):
        check(jaccard.cluster(docs, chunk).collect(), docs)


def test_chains_in_several_components(spark):
    """Groups that share a passage but are not all near copies: what the chunks leave open is multiplied after them."""
    rng = random.Random(5)
    shared = " ".join(f"s{k}" for k in range(40))
    own = [" ".join(f"f{f}w{rng.randint(0, 10**6)}" for _ in range(12)) for f in range(4)]
    texts = [f"{shared} {own[rng.randrange(4)]} {' '.join(f'y{rng.randint(0, 10**6)}' for _ in range(rng.randint(0, 3)))}" for _ in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (4, 8):
        check(jaccard.cluster(docs, chunk).collect(), docs)


def test_row_groups_hold_every_set():
    rng = np.random.default_rng(0)
    for _ in range(30):
        m = int(rng.integers(2, 40))
        sig, n = rng.permutation(1000)[:m].astype(np.int64), rng.integers(50, 80, m)
        chains = {}
        for chain, place, low, high, g in jaccard.row_groups(np.zeros(m, np.uint64), sig, n, 4):
            size = dict(zip(sig.tolist(), n.tolist(), strict=True))
            assert low == min(size[x] for x in g.tolist()) and high == max(size[x] for x in g.tolist()) and len(g) <= 5
            chains.setdefault(chain, []).append((place, g.tolist()))
        for chain, parts in chains.items():
            parts.sort()
            assert chain is None or all(a[-1] == b[0] for (_, a), (_, b) in zip(parts, parts[1:], strict=False))
        group = {x: chain for chain, parts in chains.items() if chain is not None for _, g in parts for x in g}
        for i in range(m):
            for j in range(m):
                if chains and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and i != j:
                    assert group.get(int(sig[i])) == group.get(int(sig[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100}


def test_documents_without_an_id_stay(spark, small):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, None), (None, text)], "doc_id long, text string")
    assert Counter(map(tuple, jaccard.cluster(docs).collect())) == Counter({(1, 4, 1): 1, (2, 4, 1): 1, (None, 0, None): 3})
    assert Counter(map(tuple, jaccard.stage(spark, docs, small).collect())) == Counter({(1, text): 1, (None, text): 2, (None, None): 1})


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 200))
        both = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        x = np.unique(both[:n])
        y = np.unique(np.concatenate((x[: int(rng.integers(0, len(x) + 1))], both[n : n + int(rng.integers(1, n + 1))])))
        raw = jaccard.parities(np.concatenate((x, y)), np.array([len(x), len(x) + len(y)]))
        rows = jaccard.Parities(np.array([len(x), len(y)]), raw)
        same = len(np.intersect1d(x, y))
        linked = 100 * same >= 80 * (len(x) + len(y) - same)
        assert rows.near(np.array([0]), np.array([1]))[0] or not linked
        assert rows.near(np.array([0]), np.array([0]))[0]


def test_products_count_overlaps(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(jaccard, "SLAB_CELLS", 64)
    for _ in range(40):
        m = int(rng.integers(2, 9))
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(m)]
        sets[1] = np.unique(np.append(sets[0], np.uint64(99)))
        n = np.array([len(x) for x in sets])
        counts = jaccard.overlaps(np.concatenate(sets), np.repeat(np.arange(m), n), n)
        for i in range(m):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                assert (counts[i, j] >= jaccard.required(n[i], n[j])) == (100 * k >= 80 * (n[i] + n[j] - k))


def test_large_parts_in_chunks(spark, monkeypatch):
    """Parts of many rows over several size bands: chunks of few rows and shingles find the same links."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(120):
        w = base + [f"z{j}" for j in range(k // 4)]
        w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "PART_SHINGLES", 400)
    check(jaccard.cluster(docs, 6).collect(), docs)
