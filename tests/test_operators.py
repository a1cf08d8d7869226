"""Boundary cases by hand, and the grouped tests against independent arithmetic."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import fx
from tidemark.operators import bars, book, pairs, sizing, stats


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("v")).first()["v"]


def test_pairs_and_sides(spark):
    for text, want in {" eur/usd ": ("EUR", "USD"), "EURUSD": ("EUR", "USD"), "EUR_USD": ("EUR", "USD"), "EU/USD": None, "": None, "EURUS1": None}.items():
        got = one(spark, fx.parse_pair(F.col("t")), t=text)
        assert (tuple(got) if got else None) == want
    for text, want in {"Strong BUY": "buy", "go short": "sell", "buy or sell": None, "up": "buy", "up short": None, "hold": None, "buyer": None, "bearish": "sell"}.items():
        assert one(spark, fx.side_of_text(F.col("t")), t=text) == want


def test_order_amount_limits(spark):
    def size(lots, unit=1000.0, low=0.0, high=0.0, most=100.0):
        r = one(spark, fx.order_amount(F.col("l"), F.lit(unit), F.lit(low), F.lit(high), most), l=lots)
        return r["amount"], r["error"]

    assert size(2.9) == (2000.0, None) and size(0.5) == (None, "below one step") and size(0.0) == (None, "no lots")
    assert size(1.0, low=2500.0) == (3000.0, None) and size(9.0, high=5500.0) == (5000.0, None)
    assert size(500.0) == (100000.0, None) and size(2.0, high=500.0) == (None, "above maximum")


def test_volume_needs_ten_days(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("A", day + dt.timedelta(days=i), float(i)) for i in range(9)] + [("B", day + dt.timedelta(days=i), 1.0) for i in range(10)] + [("B", day + dt.timedelta(days=99), None)]
    got = {r["symbol"]: r["adv"] for r in bars.average_daily_volume(spark.createDataFrame(rows, "symbol string, ts timestamp, volume double")).collect()}
    assert got == {"A": None, "B": 1.0}


def spread_frame(spark, values):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", "b", day + dt.timedelta(hours=i), float(v)) for i, v in enumerate(values)], "y string, x string, ts timestamp, spread double")


def by_hand(values):
    p10, p30, p70, p90 = np.percentile(values, [10, 30, 70, 90])
    out = {"high": [], "low": []}
    for kind, sign, enter, leave in (("high", 1, p90, p70), ("low", -1, -p10, -p30)):
        start, v = None, [sign * x for x in values]
        for i, x in enumerate(v):
            if start is None:
                if x >= enter and (i == 0 or v[i - 1] < enter):
                    start = i
            elif x <= leave:
                out[kind].append((start, i))
                start = None
    return out


def test_episodes_follow_the_rule_row_by_row(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=80).round(2), rng.integers(0, 4, 40), np.cumsum(rng.normal(size=90)), np.ones(30), np.array([5.0] + [0.0, 1.0] * 15)):
        got = {"high": [], "low": []}
        zero = dt.datetime(2024, 1, 1)
        for r in pairs.episodes(spread_frame(spark, values)).collect():
            got[r["kind"]].append(tuple(int((t - zero).total_seconds() // 3600) for t in (r["start"], r["stop"])))
        assert {k: sorted(v) for k, v in got.items()} == by_hand(list(map(float, values)))


def test_book_has_no_shared_currency(spark):
    rows = [("d", 1, "EUR/USD", "EUR", "USD", "long", 1.0, 1.0), ("d", 2, "EUR/JPY", "EUR", "JPY", "short", -0.9, 0.9), ("d", 3, "GBP/CHF", "GBP", "CHF", "short", -0.8, 0.8), ("d", 4, "USD/CAD", "USD", "CAD", "long", 0.7, 0.7)]
    ranking = spark.createDataFrame(rows, "forecast_date string, rank int, primary_pair string, base string, quote string, expected_side string, pair_score double, abs_score double")
    walked = book.select_book(ranking)
    assert [(r["selection_rank"], r["primary_pair"], r["side"]) for r in book.selected(walked).orderBy("selection_rank").collect()] == [(1, "EUR/USD", "buy"), (2, "GBP/CHF", "sell")]
    assert [(r["primary_pair"], r["skipped_because"]) for r in book.skips(walked).collect()] == [("EUR/JPY", "shares EUR with already-selected pair(s)")]


def test_history_round_trip(spark, tmp_path):
    path = str(tmp_path / "history")
    one_pass = spark.createDataFrame([("2024-01-01T17:00:00", [("list", "x")])], "finished_at string, errors array<struct<step:string,error:string>>")
    book.append_history(one_pass, path, "finished_at")
    book.append_history(one_pass.withColumn("finished_at", F.lit("2024-01-02T17:00:00")), path, "finished_at")
    got = book.summary(book.read_history(spark, path)).collect()
    assert [r["finished_at"] for r in got] == ["2024-01-02T17:00:00", "2024-01-01T17:00:00"] and got[0]["n_errors"] == 1 and got[0]["actions"] == "(none)"


def test_conversions(spark):
    quotes = spark.createDataFrame([(0, "EUR/USD", 1.0, 1.2, 5, "T"), (1, "USD/JPY", 100.0, 102.0, 3, "T"), (2, "AUD/NZD", 1.0, 1.1, 5, "T"), (3, "GBP/USD", 1.3, 1.2, 5, "T")], "offer_idx int, instrument string, bid double, ask double, digits int, subscription_status string")
    got = {(r["src"], r["dst"]): (r["hops"], r["mult"]) for r in sizing.conversions(quotes).collect()}
    assert got["EUR", "JPY"][0] == 2 and math.isclose(got["EUR", "JPY"][1], 1.1 * 101) and ("EUR", "AUD") not in got and ("GBP", "USD") not in got


def test_known_values_of_the_tests(spark):
    p = {r["t"]: r["p"] for r in spark.createDataFrame([(-3.34,), (1.0,), (-20.0,)], "t double").select("t", stats.mackinnon_p(F.col("t")).alias("p")).collect()}
    assert abs(p[-3.34] - 0.05) < 0.002 and p[1.0] == 1.0 and p[-20.0] == 0.0
    rng = np.random.default_rng(0)
    walk, noise, other = np.cumsum(rng.normal(size=400)), rng.normal(size=400), np.cumsum(rng.normal(size=400))
    rows = [(name, "x", k, float(y), float(walk[k])) for name, ys in (("tied", 2 * walk + noise), ("loose", other), ("same", 2 * walk + 1), ("flat", 0 * walk)) for k, y in enumerate(ys)]
    rows += [("short", "x", k, float(k * k), float(k)) for k in range(3)]
    got = {r["y"]: (r["coint_t"], r["pvalue"]) for r in stats.cointegration(spark.createDataFrame(rows, "y string, x string, ts int, ly double, lx double")).collect()}
    assert got["tied"][1] < 0.01 and got["loose"][1] > 0.05 and got["same"] == (-math.inf, 0.0) == got["flat"] and "short" not in got
    lead = rng.normal(size=200)
    follow = np.concatenate(([0.0], 0.8 * lead[:-1])) + 0.3 * rng.normal(size=200)
    rets = [("f", "l", k, float(a), float(b)) for k, (a, b) in enumerate(zip(follow, lead))] + [("s", "l", k, float(follow[k]), float(lead[k])) for k in range(10)]
    led = {r["y"]: r["granger_p"] for r in stats.granger(spark.createDataFrame(rets, "y string, x string, ts int, ry double, rx double")).collect()}
    assert led["f"] < 1e-6 and led["s"] is None
