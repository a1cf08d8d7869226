import math
import random

import numpy as np
import pytest

from tidemark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n long, component int"


def brute(rows):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} from numpy's eigenvectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = (n * x - s).astype(object)
    centred = off.astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(8, int((e > 1e-6 * e.sum()).sum()))
    white = centred @ v[:, :k] / np.sqrt(e[:k])
    return e, k, {(i, c + 1): (n, int((o * o).sum()), abs(w[c]), e[c] / e.sum()) for (i, _), o, w in zip(good, off, white) for c in range(k)}


def agree(got, rows):
    e, k, want = brute(rows)
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(white, rel=1e-7, abs=1e-7) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    agree(W.op12_whitening(spark, small).collect(), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_edges(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1 + j) for j in range(5)]) for k in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [1.0, math.nan, 1.0, 1.0, 1.0]), (104, [1.0, -math.inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], SCHEMA)
    agree(W.whiten(df).collect(), rows + bad)
    other = [(200 + k, [rng.random(), rng.random()]) for k in range(9)]  # another length is fitted by itself
    both = W.whiten(spark.createDataFrame([(*r, 1, 2) for r in rows + bad + other], SCHEMA)).collect()
    agree([r for r in both if r["vec_id"] < 100], rows)
    agree([r for r in both if r["vec_id"] >= 200], other)
    doubled = W.whiten(df.unionByName(df)).collect()  # repeated rows, null ids
    assert len(doubled) == 60 * 5 * 2 and {r["n"] for r in doubled} == {120}
    assert len(W.whiten(spark.createDataFrame([(None, [0.0, 1.0], 1, 1), (None, [1.0, 5.0], 1, 1)], SCHEMA)).collect()) == 2
    assert W.whiten(df.limit(0)).count() == 0
    assert W.whiten(df.where("vec_id = 1")).count() == 0  # one vector has no spread
    assert W.whiten(df.where("vec_id >= 100")).count() == 0


def test_equal_eigenvalues_and_few_dimensions(spark):
    corners = [(k, [float((k >> j & 1) * 2 - 1) for j in range(4)] + [7.0]) for k in range(16)]
    got = W.whiten(spark.createDataFrame([(*r, 1, 2) for r in corners], SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4} and max(r["identity_error"] for r in got) < 1e-12
    assert all(r["explained"] == pytest.approx(0.25, rel=1e-12) for r in got)


def test_beyond_longs(spark):
    rows = [(k, [1e15 * k, 3e15 - 2e15 * (k % 3)]) for k in range(6)]
    got = W.whiten(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()
    _, _, want = brute(rows)
    assert len(got) == 12 and all(r["deviation"] is None and int(r["deviation_big"]) == want[r["vec_id"], r["component"]][1] for r in got)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_polynomial_and_roots():
    rng = random.Random(4)
    for d in (1, 2, 3, 7, 12):
        for low in (False, True):
            x = np.array([[rng.randint(-50, 50) for _ in range(d)] for _ in range(max(1, d // 2) if low else 3 * d)], dtype=object)
            m = x.T @ x
            found = W.primes(int((int(np.trace(m)) // d + 2) ** d).bit_length())
            e = W.remaindered(np.stack([W.symmetric(m, p) for p in found]).astype(object), found)
            # Newton's identities, exactly
            power, sums, want = np.eye(d, dtype=object), [], [1]
            for k in range(1, d + 1):
                power = power @ m
                sums.append(int(np.trace(power)))
                want.append(sum((-1) ** (j - 1) * want[k - j] * sums[j - 1] for j in range(1, k + 1)) // k)
            assert e == want
            bits, roots = W.largest_roots(e, 8)
            values = np.linalg.eigvalsh(m.astype(float))[::-1]
            assert [r / 2**bits for r in roots] == pytest.approx(list(values[: len(roots)]), rel=1e-9)
            assert len(roots) == min(8, int((values > 1e-6).sum()))


def test_roots_that_meet():
    # (x - 3)^3 (x - 2)(x - 1)^2
    poly = np.poly1d([1])
    for r in (3, 3, 3, 2, 1, 1):
        poly = poly * np.poly1d([1, -r])
    e = [int(abs(round(c))) for c in poly.coeffs]
    bits, roots = W.largest_roots(e, 8)
    assert [r / 2**bits for r in roots] == [3, 3, 3, 2, 1, 1]
    assert len(W.largest_roots(e, 2)[1]) == 2
