import math
from collections import Counter

import duckdb
import numpy as np

from tidemark.llm import topk


def brute(rows):
    v = []
    for i, x in rows:
        if i is not None and x and all(y is not None and math.isfinite(y) for y in x):
            v.append((i, [int(y) for y in np.floor(64 * np.asarray(x, dtype=np.float64))]))
    out = Counter()
    for q in {i for i, _ in v if i % 20 == 0}:
        scores = sorted((-min(sum(a * b for a, b in zip(x, y)), 2**63 - 1), i) for p, x in v if p == q for i, y in v if i != q and len(x) == len(y))[:20]
        out.update((q, k, i, -s) for k, (s, i) in enumerate(scores, 1))
    return out


def check(df, **more):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **more).collect()]
    assert Counter(got) == brute(rows)
    return got


def test_repeated_ids_are_candidates_each(spark, tmp_path):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.1, 0.0])], "vec_id long, embedding array<float>")
    assert [s for *_, s in sorted(check(df))] == [3648, 2048, 384]
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 45)), [float(round(y, 1)) for y in rng.normal(size=3)]) for _ in range(300)]
    rows += [(40, [1.0, 1.0, 1.0])] * 60 + [(20, [1.0, 1.0, 1.0])] * 30 + [(k, [1.0, 1.0, 1.0]) for k in range(30)]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block_rows in (16, 4096):
        got = check(many, block_rows=block_rows)
    many.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert Counter(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({topk.SQL}) q").fetchall()) == Counter(got)


def test_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/embeddings.parquet"))


def test_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    x = centres[rng.integers(0, 5, 600)] + 0.2 * rng.normal(size=(600, 8))
    x[::3] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    check(df, block_rows=50)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, []), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (5, [-1.0, 0.5]), (7, [1.0, 2.0]), (140, [0.0, 0.0]), (3, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, block int")
    check(df)
    check(df, block_rows=2)
    assert topk.top_k(df.where("false")).count() == 0


def test_large_components_score_exactly(spark):
    rows = [(i, [1e7 + i / 64, -3.0, 1e7 - i / 64]) for i in range(60)] + [(100 + i, [2.0**25 + i, float(i)]) for i in range(40)] + [(200 + i, [2.0**40 + i]) for i in range(30)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=16)


def test_cover_tree_invariants():
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(300, 4)), rng.normal(size=(100, 4)) * 0.01 + 2, np.repeat(rng.normal(size=(1, 4)), 50, axis=0)))
    seen = []

    def walk(node):
        apart = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1))
        assert np.isclose(apart.max(), node.radius) and node.radius <= 2.0**node.level * (1 + 1e-12) or node.radius == 0
        if not node.children:
            seen.extend(node.rows.tolist())
            return
        assert (node.children[0].centre == node.centre).all()
        for i, a in enumerate(node.children):
            assert a.level <= node.level - 1 or a.radius == 0
            assert np.sqrt(((x[a.rows] - a.centre) ** 2).sum(axis=1)).max() <= 2.0 ** (node.level - 1) * (1 + 1e-6)
            assert all(np.sqrt(((a.centre - b.centre) ** 2).sum()) > 2.0 ** (node.level - 1) for b in node.children[:i])
            walk(a)

    walk(topk.Node(x, np.arange(len(x)), 0, None, 4))
    assert sorted(seen) == list(range(len(x)))


def test_cells_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(topk, "PIVOTS", 2)
    monkeypatch.setattr(topk, "SUB_PIVOTS", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    x[:150] = x[0]
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    blocks = topk.placed(topk.quantised(df), 25).groupBy("block").count().collect()
    assert max(r["count"] for r in blocks) <= 75 and len(blocks) > 8
    check(df, block_rows=25)


def test_branches_lose_no_pair_of_blocks(spark):
    """Pairs of blocks by way of branches are those that every pair of blocks alone would leave."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(120):
        d = 3 if k % 10 else 2
        c, q = rng.normal(size=(2, d)) * (5 if k % 3 else 0.2)
        asks = k % 4 != 0
        rows.append((k, d, c.tobytes(), float(rng.random()), q.tobytes() if asks else None, float(rng.random()) if asks else None, int(rng.integers(-5, 25)) if asks else None))
    got = {(r["block"], r["other"]) for r in topk.block_pairs(spark.createDataFrame(rows, topk.SUMMARY)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] != b[0] and a[1] == b[1] and b[4] is not None:
                (q, norm), (c, other) = topk._centre(b[4]), topk._centre(a[2])
                if topk.largest(q, norm, b[5], c[None], np.array([other]), np.array([a[3]]))[0] >= b[6]:
                    want.add((a[0], b[0]))
    assert got == want and 0 < len(want) < 120 * 60
