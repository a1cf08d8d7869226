import re
from collections import Counter, defaultdict

from tidemark.llm import packing


def check(docs, rows, capacity=packing.CAPACITY):
    packing.check_bins(rows, capacity)
    want = Counter()
    text, source = defaultdict(set), defaultdict(set)
    for r in docs.collect():
        want[r["doc_id"]] += max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
        text[r["doc_id"]].add(r["text"] or "")
        source[r["doc_id"]].add(r["source"])
    got, held = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["n_words"]
        if r["n_words"] < capacity:
            held[r["bin_id"]].append(r["doc_id"])
    assert got == want
    for ids in held.values():
        one = [i for i in ids if len(text[i]) == 1]  # ids of one text
        assert len({t for i in one for t in text[i]}) == len(one)
        assert max(Counter(s for i in ids for s in source[i] if len(source[i]) == 1).values(), default=0) <= packing.PER_SOURCE


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"), packing.op8_best_fit_packing(spark, small).collect())


def test_edges(spark, edge, empty):
    check(edge, packing.pack(edge).collect())
    assert packing.pack(empty).count() == 0
    check(edge, packing.pack(edge, shard_rows=2).collect())


def brute(length, source, cluster, capacity, per_source):
    bins = []
    for n, s, c in zip(length, source, cluster):
        fit = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= n and c not in b["c"] and b["s"][s] < per_source]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "c": set(), "s": Counter()})
        bins[k]["left"] -= n
        bins[k]["c"].add(c)
        bins[k]["s"][s] += 1
        yield k


def test_best_fit_is_the_tightest():
    import random

    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 60)
        length = sorted((rng.randint(1, 30) for _ in range(n)), reverse=True)
        source, cluster = [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        assert packing.best_fit(length, source, cluster, 30, 2)[0] == list(brute(length, source, cluster, 30, 2))
