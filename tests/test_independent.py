"""Independent checks of what SQL does not express: the two tests, the scan, the screening, the basket and the report."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import bars as B
from tidemark.operators import book as K
from tidemark.operators import pairs as P
from tidemark.operators import sizing
from tidemark.plans import queries
from tidemark.sources import standins as X

SF = "/root/testdata/sf0.001"


def residual(y, columns):
    """By the normal equations, not by the library's least squares: coefficients, residuals, first standard error."""
    x = np.column_stack(columns)
    inverse = np.linalg.inv(x.T @ x)
    b = inverse @ x.T @ y
    e = y - x @ b
    return b, e, math.sqrt(inverse[0, 0] * (e @ e) / (len(y) - x.shape[1]))


def engle_granger(ly, lx):
    _, e, _ = residual(ly, [lx, np.ones(len(lx))])
    d, n = e[1:] - e[:-1], len(e)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)

    def regression(lags, drop):
        rows = range(drop, n - 1)
        return residual(np.array([d[t] for t in rows]), [np.array([e[t] for t in rows]), *(np.array([d[t - k] for t in rows]) for k in range(1, lags + 1))])

    def aic(lags):
        _, r, _ = regression(lags, top)
        return len(r) * math.log(r @ r / len(r)) + 2 * (lags + 1)

    lags = min(range(top + 1), key=aic)
    b, _, se = regression(lags, lags)
    return b[0] / se


def f_tail(f, d1, d2):
    """The tail of the F distribution by summing its density over w = d2 / (d2 + d1 f), which is beta distributed."""
    top = d2 / (d2 + d1 * f)
    w = (np.arange(200_000) + 0.5) * top / 200_000
    a, b = d2 / 2, d1 / 2
    log = (a - 1) * np.log(w) + (b - 1) * np.log1p(-w) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return float(np.exp(log).sum() * top / 200_000)


def granger(follow, lead):
    ps = []
    for lag in range(1, min(5, max(1, len(follow) // 10)) + 1):
        rows = range(lag, len(follow))
        y = np.array([follow[t] for t in rows])
        own = [np.array([follow[t - k] for t in rows]) for k in range(1, lag + 1)]
        other = [np.array([lead[t - k] for t in rows]) for k in range(1, lag + 1)]
        one = np.ones(len(y))
        small, full = (residual(y, c)[1] for c in ([*own, one], [*own, *other, one]))
        dof = len(y) - 2 * lag - 1
        ps.append(f_tail((small @ small - full @ full) / lag / (full @ full / dof), lag, dof))
    return min(ps)


@pytest.fixture(scope="module")
def aligned(spark):
    return P.align(queries.weekly(spark, SF), queries.groups(spark, SF), 20).cache()


def series(df, *columns):
    out = defaultdict(list)
    for r in df.orderBy("ts").collect():
        out[r["y"], r["x"]].append([r[c] for c in columns])
    return {k: np.array(v).T for k, v in out.items()}


def test_cointegration_of_every_pair(spark, aligned):
    data = series(aligned, "ly", "lx")
    rows = queries.pairs_cointegration(spark, SF).collect()
    assert {(r["y"], r["x"]) for r in rows} == set(data) and len(rows) > 100
    for r in rows:
        assert math.isclose(r["coint_t"], engle_granger(*data[r["y"], r["x"]]), rel_tol=1e-6, abs_tol=1e-5)
        assert 0 <= r["pvalue"] <= 1


def test_granger_of_every_pair(spark, aligned):
    data = series(P.returns(aligned), "ry", "rx")
    rows = queries.pairs_granger(spark, SF).collect()
    assert {(r["y"], r["x"]) for r in rows} == set(data)
    for r in rows[:120]:
        follow, lead = data[r["y"], r["x"]]
        if r["granger_p"] is None:
            assert len(follow) < 20
        else:
            assert math.isclose(r["granger_p"], granger(follow, lead), rel_tol=1e-3, abs_tol=1e-5)


def test_scan_keeps_order_and_gates(spark):
    """Each row's p and statistics are those of the pair alone; no pair is missed that passes every gate."""
    weekly, groups = queries.weekly(spark, SF), queries.groups(spark, SF)
    rows = queries.scan_all_pairs(spark, SF).collect()
    assert rows and [r["pvalue"] for r in rows] == sorted(r["pvalue"] for r in rows) and len(rows) <= 200
    assert all(r["pvalue"] <= 0.5 and r["n_high"] >= 1 and r["n_low"] >= 1 and not r["near_duplicate"] for r in rows)
    tests = {(r["y"], r["x"]): r["pvalue"] for r in queries.T.cointegration(P.align(B.last_days(weekly, 3650), groups, 20)).collect()}
    assert all(math.isclose(tests[r["y"], r["x"]], r["pvalue"], abs_tol=1e-6) for r in rows)
    moves = {(r["y"], r["x"]) for r in P.episode_summary(P.episodes(P.spreads(P.align(B.last_days(weekly, 3650), groups, 20)))).where("n_high >= 1 AND n_low >= 1").collect()}
    duplicates = {(r["y"], r["x"]) for r in P.fit_stats(P.spreads(P.align(B.last_days(weekly, 3650), groups, 20))).where("near_duplicate").collect()}
    want = {k for k, p in tests.items() if p <= 0.5} & moves - duplicates
    assert len(want) > 200 or {(r["y"], r["x"]) for r in rows} == want


def test_basket_row_by_row(spark):
    quotes = {r["instrument"]: r for r in spark.sql(X.QUOTES).collect()}
    rates = {(r["src"], r["dst"]): r["mult"] for r in sizing.conversions(spark.sql(X.QUOTES)).collect()}
    accounts = {r["account_id"]: r for r in X.sql(spark, SF, queries.ACCOUNTS).collect()}
    orders = {r["order_id"]: r for r in X.sql(spark, SF, queries.ORDERS).collect()}
    rows = queries.sizing_basket(spark, SF).collect()
    assert len(rows) == len(orders)
    for r in rows:
        o = orders[r["order_id"]]
        q, a = quotes.get(o["primary_pair"]), accounts.get(o["account_id"])
        equity = next((float(v) for v in (a["equity"], a["balance"], a["gross_pl"], a["usable_margin"]) if v is not None and v > 0), None) if a else None
        money = (a["currency"] or "").strip().upper() if a else None
        money = money if money and len(money) == 3 else "USD"
        error = "no offer" if q is None else "not subscribed" if q["subscription_status"] != "T" else "bad quote" if not 0 < q["bid"] <= q["ask"] else "no equity" if equity is None else None
        base, lots = o["primary_pair"][:3], None if o["lots"] is None else float(o["lots"])
        if error is None and lots is None:
            mult = 1.0 if money == base else rates.get((money, base))
            lots = None if mult is None else equity * float(o["pct_equity"]) / 100 * float(o["leverage"]) * mult / 1000
            error = "no conversion" if mult is None else None
        amount = None
        if error is None:
            steps = math.floor(min(lots, 100.0) + 1e-9)
            error = "no lots" if lots <= 0 else "below one step" if steps < 1 else None
            amount = None if error else min(max(steps * 1000.0, 2000.0), 50_000.0)
        assert r["error"] == error, (r, o)
        if amount is None:
            assert r["amount"] is None and r["stop_rate"] is None
        else:
            assert math.isclose(r["amount"], amount) and math.isclose(r["lots"], amount / 1000)
            digits = min(max(q["digits"], 1), 10)
            raw = q["ask"] * 0.99 if o["is_buy"] else q["bid"] * 1.01
            assert abs(r["stop_rate"] - raw) <= 0.5000001 * 10**-digits


def written_out(p):
    """The report of one payload, line by line."""
    out = ["=" * 90, f"[{p.started_at} -> {p.finished_at}] forecast={p.target_forecast_date} top_n={p.config.top_n} max_open={p.config.max_open} enabled={p.config.enabled} dry_run={p.dry_run}"]
    if p.ranking:
        out += ["Ranking (top 10 by |pair_score|):"]
    out += [f"  #{r.rank:>2}  {r.primary:<10} {r.expected_side:<6} score={r.pair_score:+.4f}  |score|={r.abs_score:.4f}" for r in p.ranking[:10]]
    out += [f"Selected book (top {len(p.selected_book)}, currency-disjoint):"] if p.selected_book else ["Selected book: (empty)"]
    for s in p.selected_book:
        out += [f"  ##{s.selection_rank} {s.primary:<10} {s.side:<5} |score|={s.abs_score:.4f}  rank={s.ranking_rank}", f"      reason: {s.reason}"]
    out += ["Overlap skips (candidates passed over for currency overlap):"] if p.overlap_skips else []
    out += [f"  - {s.primary:<10} ranking_rank={s.ranking_rank} |score|={s.abs_score:.4f}  {s.skipped_because}" for s in p.overlap_skips]
    out += ["Open positions:"] if p.open_positions else ["Open positions: (none)"]
    out += [f"  {o.primary:<10} {o.side:<5} lots={o.lots:g} amount={o.amount} open_rate={o.open_rate} gross_pl={o.gross_pl}" for o in p.open_positions]
    out += ["Decisions:"] if p.decisions else []
    out += [f"  {d.decision.upper():<5} {d.primary:<10} {d.side:<5} -- {d.reason}" for d in p.decisions]
    out += ["Planned opens:"] if p.planned_opens else []
    out += [f"  OPEN  {o.primary:<10} {o.side:<5} -- {o.reason}" for o in p.planned_opens]
    out += ["Actions executed:"] if p.actions else ["Actions executed: (none - dry run because auto-trade disabled)" if p.dry_run else "Actions executed: (none)"]
    out += [f"  {a.kind.upper()} {a.primary} [{a.status}] {a.message or a.error or ''}" for a in p.actions]
    out += ["Errors:"] if p.errors else []
    return "\n".join(out + [f"  [{e.step}] {e.error}" for e in p.errors])


def test_report_says_what_the_payload_holds(spark):
    passes = {r["finished_at"]: r for r in queries.history(spark, SF).collect()}
    rows = queries.book_report(spark, SF).collect()
    assert {r["finished_at"] for r in rows} == set(passes) and any(p.dry_run for p in passes.values()) and any(p.actions for p in passes.values())
    for r in rows:
        assert r["report"] == written_out(passes[r["finished_at"]])


def test_every_ticket_is_in_the_payload(spark):
    """Two tickets of one pair and side stay two, each with its own data."""
    positions = spark.createDataFrame([("d", 7, "EUR/USD", "B", 1000.0, 1.5, 3.0), ("d", 3, "EUR/USD", "B", 2000.0, 1.25, -4.0), ("d", 9, "USD/JPY", "S", 5.0, 2.0, 0.0)], "forecast_date string, trade_id long, instrument string, buy_sell string, amount double, open_rate double, gross_pl double")
    chosen = spark.createDataFrame([("d", 1, "EUR/USD", "buy", "long", 0.5, 0.5, 2, "because"), ("d", 2, "AUD/NZD", "sell", "short", -0.25, 0.25, 4, "next")], "forecast_date string, selection_rank int, primary_pair string, side string, expected_side string, pair_score double, abs_score double, ranking_rank int, reason string")
    p = K.normal_positions(positions)
    c = K.diff(p, chosen)
    opens = K.capped_opens(c, 3)
    results = spark.createDataFrame([("d", "close", "USD/JPY", "sell", 9, None, "refused"), ("d", "open", "AUD/NZD", "sell", None, None, "subscription_status is V")], "forecast_date string, kind string, primary_pair string, side string, trade_id long, message string, error string")
    passes = spark.sql("SELECT 'd' AS forecast_date, 's' AS started_at, 'f' AS finished_at, false AS dry_run, named_struct('enabled', true) AS config")
    parts = {"selected_book": chosen, "open_positions": p, "decisions": c.where("decision <> 'open'"), "planned_opens": opens, "actions": K.done_actions(c, opens, results)}
    row = K.payloads(passes, parts).first()
    assert [(d.trade_id, d.decision, d.amount, d.open_rate, d.gross_pl, d.today_side) for d in row.decisions] == [(3, "keep", 2000, 1.25, -4.0, "long"), (7, "keep", 1000, 1.5, 3.0, "long"), (9, "close", 5, 2.0, 0.0, None)]
    assert row.decisions[0].reason == "already on and matches selection #1 (EUR/USD long, |score| 0.5000) - kept (no churn)"
    assert [(o.selection_rank, o.primary, o.reason) for o in row.planned_opens] == [(2, "AUD/NZD", "next")]
    assert [(a.kind, a.status, a.message, a.error) for a in row.actions] == [("close", "error", None, "close failed for USD/JPY sell (9): refused"), ("skip_unsubscribed", "skipped", "subscription_status is V", None)]
    assert row.ranking == [] and row.errors == []


def test_history_is_appended_once(spark, tmp_path):
    d, path = queries.history(spark, SF).cache(), str(tmp_path / "history")
    n = d.count()
    K.append_history(d.where("finished_at < '2024-01-15'"), path)
    K.append_history(d, path)
    K.append_history(d.where("finished_at > '2024-01-10'"), path)  # a pass written again leaves one line
    assert K.read_history(spark, path).count() == n and K.bad_lines(spark, path) == 0
    (tmp_path / "history" / "batch=x").mkdir()
    (tmp_path / "history" / "batch=x" / "part-0.txt").write_text('{"finished_at": "2030-01-01"\n\n[1]\nnot json\n{"other": 1}\n{"finished_at": "2030-01-02", "errors": [{"step": "a", "error": "b"}]}\n')
    assert K.bad_lines(spark, path) == 4 and K.read_history(spark, path).count() == n + 1
    assert K.section(K.latest(K.read_history(spark, path)), "errors").collect()[0].asDict() == {"finished_at": "2030-01-02", "step": "a", "error": "b"}
    assert [r["value"] for r in K.section(spark.sql("SELECT 'f' AS finished_at, array('p', 'q') AS errors"), "errors").collect()] == ["p", "q"]


def test_placeholders(spark):
    rows = B.placeholder_status(spark).collect()
    assert len(rows) == 5 and all(r["yahoo_symbol"] is None and r["note"].startswith("N/A") for r in rows)
