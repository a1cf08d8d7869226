import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import sharding


def check(docs, rows, shards=16):
    def named(i, raw):
        return i, len(raw) + 1, zlib.crc32(raw)

    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(named(i, (t or "").encode()) for i, t in held)
    text = {named(i, (t or "").encode()): t for i, t in held}
    by_shard, home = defaultdict(list), {}
    for r in rows:
        by_shard[r["shard"]].append(r)
        t = text[r["doc_id"], r["size"], r["text_crc32"]]
        assert home.setdefault(t, r["shard"]) == r["shard"]
    for held in by_shard.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    groups = sharding.keyed(docs).groupBy("g1", "g2").agg(F.sum("size").alias("size")).orderBy("g1", "g2").collect()
    ends = sharding.brute_cuts([g["size"] for g in groups], shards)
    want, at = [], 0
    for e in ends:
        want.append(e - at)
        at = e
    assert [sum(r["size"] for r in by_shard[k]) for k in range(len(want))] == want


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"), sharding.op9_sharding(spark, small).collect())


def test_edges(spark, edge, empty):
    check(edge, sharding.shard(edge).collect())
    assert sharding.shard(empty).count() == 0


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FETCH_GROUPS", 0)
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 7 + 1), "en", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(docs, sharding.shard(docs).collect())
