"""Bars, signals, positions and quotes derived from the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BARS = """
SELECT symbol, ts, volume, close, close AS open, close * 1.01 AS high, close * 0.99 AS low FROM (
  SELECT symbol, ts, volume, round(100 * exp(sum(step) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS close FROM (
    SELECT p_brand AS symbol, CAST(date_trunc('{unit}', l_shipdate) AS TIMESTAMP) AS ts, sum(l_quantity) AS volume, round(avg(l_discount) - 0.05, 9) AS step
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, CAST(date_trunc('{unit}', l_shipdate) AS TIMESTAMP)) x) y
"""
WEEKLY = _BARS.format(unit="week")
DAILY = _BARS.format(unit="day")
#: The pairs of the currency universe, in order.
UNIVERSE = "EUR/USD GBP/USD USD/JPY USD/CHF AUD/USD NZD/USD USD/CAD EUR/JPY EUR/GBP GBP/JPY".split()
PAIRS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(UNIVERSE)) + ") AS t(universe_idx, primary_pair)"
GROUPS = "SELECT DISTINCT p_brand AS symbol, concat('g', CAST(CAST(substring(p_brand, 7) AS INT) % 8 AS VARCHAR(9))) AS group_id FROM part WHERE CAST(substring(p_brand, 7) AS INT) % 4 <> 0"
SIGNALS = f"""
SELECT e.event_id, u.primary_pair, CAST(CAST(e.ts AS DATE) AS VARCHAR(10)) AS forecast_date,
  CASE event_type WHEN 'signup' THEN 'BUY' WHEN 'error' THEN 'Strong short' WHEN 'purchase' THEN 'hold' END AS position,
  CASE WHEN event_type IN ('purchase', 'view') AND event_id % 3 = 0 THEN 'trend up' END AS recommendation,
  CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(event_id % 3 - 1 AS VARCHAR(3)) END AS pred_class,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(CAST(event_id % 7 AS DOUBLE) / 7, 4) END AS p_buy, round(CAST(event_id % 11 AS DOUBLE) / 11, 4) AS p_sell,
  CAST(round(CASE WHEN value < 100 THEN value ELSE 100 END / 100.0, 4) AS DOUBLE) AS avg_oos_accuracy, CAST(round(value / 10, 4) AS DOUBLE) AS binary_oos_sharpe,
  CASE WHEN event_id % 6 = 0 THEN 'Open' ELSE 'close' END AS target_return_basis
FROM events e JOIN ({PAIRS}) u ON e.user_id % 10 = u.universe_idx
"""
POSITIONS = f"""
SELECT o_orderkey AS trade_id, u.primary_pair AS instrument, CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') THEN 'B' ELSE 'S' END AS buy_sell,
  round(o_totalprice) AS amount, o_totalprice / 1000 AS open_rate, round(o_totalprice / 7, 2) AS gross_pl,
  concat('2024-01-', lpad(CAST(o_orderkey % 30 + 1 AS VARCHAR(2)), 2, '0')) AS forecast_date
FROM orders JOIN ({PAIRS}) u ON o_orderkey % 10 = u.universe_idx
"""
QUOTES = """
SELECT offer_idx, instrument, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, digits, subscription_status FROM (VALUES (0, 'EUR/USD', 1.10, 1.1002, 5, 'T'), (1, 'GBP/USD', 1.25, 1.2503, 5, 'T'), (2, 'USD/JPY', 150.1, 150.12, 3, 'T'),
  (3, 'USD/CHF', 0.90, 0.9002, 5, 'T'), (4, 'AUD/USD', 0.65, 0.6502, 5, 'D'), (5, 'NZD/USD', 0.61, 0.6, 5, 'T'), (6, 'USD/CAD', 1.35, 1.3503, 12, 'T'),
  (7, 'EUR/JPY', 165.2, 165.23, 3, 'T'), (8, 'EUR/GBP', 0.86, 0.8602, 5, 'T'), (9, 'SEK/NOK', 0.98, 0.9803, 5, 'T')
) AS t(offer_idx, instrument, bid, ask, digits, subscription_status)
"""
TABLES = ("lineitem", "part", "orders", "customer", "events", "nation")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs text over the test tables of sf_dir without leaving views behind."""
    names = [t for t in TABLES if t in text]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    for t in names:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} {t}").replace(f"{{{t}}} {t} e ", f"{{{t}}} e ")
    return spark.sql(text, **frames)
