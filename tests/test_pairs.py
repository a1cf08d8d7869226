"""Pair gates, lag moments, quantiles and episodes against plain loops."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram as G
from tidemark.operators import moments as M
from tidemark.operators import pairs as P
from tidemark.operators import quantiles as Q

T0 = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    """Missing bars, a constant series, one constant only where it meets others, a copy with noise, closes of 0."""
    rng, rows = random.Random(2), []
    walk = [math.exp(4 + 0.05 * math.sin(k / 3) + rng.gauss(0, 0.01)) for k in range(120)]
    for k in range(120):
        t = T0 + timedelta(days=k)
        rows.append(("A", t, walk[k]))
        if rng.random() < 0.6:
            rows.append(("B", t, walk[k] * (1 + 0.0001 * (k % 3))))
        if rng.random() < 0.7:
            rows.append(("C", t, 50 * math.exp(rng.gauss(0, 0.02))))
        rows.append(("D", t, 7.25))
        if k % 2:
            rows.append(("E", t, 3.0))
        elif k < 20:
            rows.append(("E", t, 2.0))
        if k < 25:
            rows.append(("F", t, 0.0 if k % 4 == 0 else 20.0 + k % 5))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")


GROUPS = [("A", "g"), ("C", "h")]


def test_gates_before_pairs(spark, bars):
    groups = spark.createDataFrame([*GROUPS, ("D", "g")], "symbol string, group_id string")
    group = {"A": "g", "C": "h", "D": "g"}
    logs = defaultdict(dict)
    for r in bars.collect():
        if r["close"] > 0:
            logs[r["symbol"]][r["ts"]] = math.log(r["close"])
    want = {}
    for y in logs:
        for x in logs:
            common = sorted(set(logs[y]) & set(logs[x]))
            if y >= x or len(common) < 15 or group.get(y, y) == group.get(x, x):
                continue
            a, b = (np.array([logs[s][t] for t in common]) for s in (y, x))
            if b.max() - b.min() < 1e-12:
                continue
            beta = np.cov(a, b, bias=True)[0, 1] / b.var()
            r = np.corrcoef(a, b)[0, 1] if a.std() > 1e-12 else math.nan
            near = abs(beta - 1) < 0.04 and (a.std() < 1e-12 or r >= 0.997)
            want[y, x] = (len(common), a.mean() - beta * b.mean(), beta, near)
    for tiles, slices in ((4, 4), (1, 1), (7, 3)):
        side = G.logs(bars, groups)
        assert G.products(side, tiles, slices).where("n >= 15").count() == G.products(side, 2, 2).where("n >= 15").count()
    got = {(r["y"], r["x"]): r for r in G.fits(bars, groups, 15).collect()}
    assert set(got) == set(want) and ("A", "D") not in got and ("C", "D") not in got and ("B", "E") in got
    for k, (n, alpha, beta, near) in want.items():
        assert (got[k]["n"], got[k]["near_duplicate"]) == (n, near)
        assert (got[k]["alpha"], got[k]["beta"]) == pytest.approx((alpha, beta), rel=1e-9, abs=1e-9)
    assert got["A", "B"]["near_duplicate"]
    kept = G.fitted(bars, G.fits(bars, groups, 15).where("NOT near_duplicate"))
    assert {(r["y"], r["x"]) for r in kept.select("y", "x").distinct().collect()} == {k for k, v in want.items() if not v[3]}
    assert kept.groupBy("y", "x").agg(F.sum("spread").alias("s")).where("abs(s) > 1e-9").count() == 0


def test_pair_rows_are_built_for_wanted_pairs_only(spark, bars):
    plan = G.rows_of(bars, spark.createDataFrame([("A", "C")], "y string, x string"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "ArrowPython" not in plan


def test_empty(spark, bars):
    assert G.fits(bars.limit(0)).count() == 0
    assert P.fit_stats(G.fitted(bars, G.fits(bars.limit(0)))).count() == 0
    assert P.episodes(G.fitted(bars, G.fits(bars.limit(0)))).count() == 0


def test_distributions(spark):
    z = [-9.0, -3.0, -2.999, -1.0, 0.0, 0.3, 2.9, 3.1, 6.0]
    d = spark.createDataFrame([(v,) for v in z], "z double").select("z", M.normal_cdf(F.col("z")).alias("p"))
    for r in d.collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel=1e-12)
    g = spark.createDataFrame([(v,) for v in (0.5, 1.0, 2.5, 71.0, 1e5)], "z double").select("z", M.ln_gamma(F.col("z")).alias("g"))
    for r in g.collect():
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-12, abs=1e-12)
    cases = [(2.3, 3, 120), (50.0, 1, 20), (0.7, 5, 31), (1.0, 2, 2), (0.0, 2, 9), (4.2, 4, 5000)]
    f = spark.createDataFrame(cases, "f double, a int, b int").select("f", "a", "b", M.f_survival(F.col("f"), F.col("a"), F.col("b")).alias("p"))
    for r in f.collect():
        a, b, f = r["a"] / 2, r["b"] / 2, r["f"]
        w = (np.arange(400_000) + 0.5) / 400_000 * (r["b"] / (r["b"] + r["a"] * f))
        with np.errstate(divide="ignore"):
            density = np.exp((b - 1) * np.log(w) + (a - 1) * np.log1p(-w) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        want = 1.0 if f == 0 else float(density.sum() / 400_000 * (r["b"] / (r["b"] + r["a"] * f)))
        assert r["p"] == pytest.approx(want, rel=2e-3)
    exact = {(1.0, 2, 2): 0.5, (0.0, 2, 9): 1.0}
    got = {(r["f"], r["a"], r["b"]): r["p"] for r in f_rows(spark, exact)}
    assert got == pytest.approx(exact, rel=1e-12)


def f_rows(spark, cases):
    return spark.createDataFrame(list(cases), "f double, a int, b int").select("f", "a", "b", M.f_survival(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()


def test_lag_moments_and_nested_regressions(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 40))
    df = spark.createDataFrame([("k", t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, y))], "k string, t int, a double, b double")
    state = M.lag_moments(df, ["k"], "t", ("a", "b"), 4)
    vs = M.variables((0, 0), (1, 1), (0, 3), (1, 0))
    for drop in (3, 4):
        m, c = state.select(M.matrix(vs, F.lit(drop), 2).alias("m"), M.factor(M.matrix(vs, F.lit(drop), 2)).alias("c")).first()
        t = np.arange(drop, 40)
        columns = [x[t], y[t - 1], x[t - 3], y[t]]
        want = np.array([[p @ q for q in columns] for p in columns])
        assert all(m[i] == pytest.approx(list(want[i][: i + 1]), rel=1e-10, abs=1e-10) for i in range(4))
        assert all(c[i] == pytest.approx(list(np.linalg.cholesky(want)[i][: i + 1]), rel=1e-9, abs=1e-9) for i in range(4))
        left = state.select(M.nested(F.array(*(F.lit(float(v)) for v in c[-1])), F.lit(float(want[3, 3])))).first()[0]
        for k in range(4):
            fit = np.linalg.lstsq(np.column_stack(columns[:k]), y[t], rcond=None)[0] if k else None
            rest = y[t] - (np.column_stack(columns[:k]) @ fit if k else 0)
            assert left[k] == pytest.approx(rest @ rest, rel=1e-9)


@pytest.mark.parametrize("held", (9, 1 << 16))
def test_quantiles(spark, held):
    rng = random.Random(9)
    groups = {
        "one": [3.5], "equal": [2.0] * 50, "ties": [float(rng.randint(0, 3)) for _ in range(400)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-4, 9) for _ in range(60)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0], "normal": [rng.gauss(0, 1) for _ in range(1500)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("nothing", None)], "g string, v double")
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r["g"]: r["p"] for r in Q.exact(df, ["g"], "v", qs, held).collect()}
    want = {r["g"]: r["p"] for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*(F.lit(q) for q in qs))).alias("p")).collect()}
    assert got == want


def walk(rows, outer, inner, sign):
    out, start, prev = [], None, None
    for ts, v in rows:
        v *= sign
        if start is None:
            if v >= outer * sign and (prev is None or prev < outer * sign):
                start = ts
        elif v <= inner * sign:
            out.append((start, ts))
            start = None
        prev = v
    return out


@pytest.mark.parametrize("span_days", (1, 5, 4000))
def test_episodes_row_by_row(spark, span_days):
    """Tied bands too, where one row both enters and leaves; spans of one row, of some, and of all."""
    rng, data = random.Random(7), {}
    for k in range(12):
        choices = [0.0, 1.0] if k < 4 else [0.0, 0.0, 0.0, 1.0] if k < 6 else [0.0, 1.0, 2.0, 3.0, 4.0]
        data["y", f"x{k}"] = [(T0 + timedelta(days=d), rng.choice(choices) if k < 10 else rng.gauss(0, 1)) for d in range(20 + 9 * k) if rng.random() < 0.8 or d < 5]
    data["y", "flat"] = [(T0 + timedelta(days=d), 1.0) for d in range(30)]
    data["y", "short"] = [(T0 + timedelta(days=d), float(d)) for d in range(19)]
    df = spark.createDataFrame([(*k, t, v) for k, rows in data.items() for t, v in rows], "y string, x string, ts timestamp, spread double")
    got = sorted((r["y"], r["x"], r["kind"], r["start"], r["stop"]) for r in P.episodes(df, span_days=span_days).collect())
    want = []
    for (y, x), rows in data.items():
        if len(rows) >= 20:
            p10, p30, p70, p90 = np.percentile([v for _, v in rows], [10, 30, 70, 90])
            want += [(y, x, "high", *e) for e in walk(rows, p90, p70, 1)] + [(y, x, "low", *e) for e in walk(rows, p10, p30, -1)]
    assert got == sorted(want) and len(want) > 30
