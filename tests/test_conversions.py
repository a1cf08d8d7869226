"""Conversions along quotes against a plain breadth-first search."""

import random
from collections import deque

import pytest

from tidemark.operators import sizing

SCHEMA = "offer_idx int, instrument string, bid double, ask double, digits int, subscription_status string"


def search(quotes, src):
    """mult and hops by a queue, neighbours in the quotes' order."""
    near = {}
    for _, name, bid, ask, _, status in quotes:
        if status == "T" and bid > 0 and ask >= bid:
            a, b, mid = name[:3], name[4:], (bid + ask) / 2
            near.setdefault(a, []).append((b, mid))
            near.setdefault(b, []).append((a, 1 / mid))
    out, queue = {src: (0, 1.0)}, deque([src])
    while queue:
        a = queue.popleft()
        for b, m in near.get(a, []):
            if b not in out:
                out[b] = (out[a][0] + 1, out[a][1] * m)
                queue.append(b)
    return out if src in near else {}


def code(k):
    return f"C{chr(65 + k // 26)}{chr(65 + k % 26)}"


def check(spark, quotes):
    rows = sizing.conversions(spark.createDataFrame(quotes, SCHEMA)).collect()
    got = {(r["src"], r["dst"]): (r["hops"], pytest.approx(r["mult"])) for r in rows}
    assert len(got) == len(rows)
    names = {n for q in quotes for n in (q[1][:3], q[1][4:])}
    assert {(s, d): v for s in names for d, v in search(quotes, s).items()} == got


def test_chain_of_nine(spark):
    check(spark, [(k, f"{code(k)}/{code(k + 1)}", 1.5 + k, 1.75 + k, 5, "T") for k in range(8)])


def test_ties_and_what_is_no_quote(spark):
    rng = random.Random(8)
    quotes = [(k, "/".join(code(c) for c in rng.sample(range(9), 2)), 1 + rng.random(), 2 + rng.random(), 5, rng.choice("TTTD")) for k in range(16)]
    quotes += [(16, "CAA/CAB", 2.0, 1.0, 5, "T"), (17, "CAA/CAC", 0.0, 1.0, 5, "T"), (18, "CZZ/CZY", 1.0, 1.0, 5, "D"), (19, "CAA/CAD", 1.0, 3.0, 5, "T"), (20, "CAA/CAD", 7.0, 9.0, 5, "T")]
    check(spark, quotes)
    assert sizing.conversions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_identity_comes_first(spark):
    rates = sizing.conversions(spark.createDataFrame([(0, "EUR/USD", 1.0, 1.5, 5, "T")], SCHEMA))
    amounts = spark.createDataFrame([(1, "eur ", "EUR", -5.0), (2, "XXX", "XXX", 3.0), (3, "EUR", "USD", 4.0), (4, "EUR", "USD", -4.0), (5, "EUR", "JPY", 4.0), (6, "EUR", "USD", None), (7, "EUR", "USD", float("inf"))], "id int, src string, dst string, amount double")
    got = {r["id"]: (r["converted"], r["error"]) for r in sizing.convert(amounts, rates).collect()}
    assert got == {1: (-5.0, None), 2: (3.0, None), 3: (5.0, None), 4: (None, "amount not positive"), 5: (None, "no path"), 6: (None, "amount not positive"), 7: (None, "amount not positive")}
