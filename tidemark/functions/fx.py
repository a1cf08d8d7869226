"""Scalar rules on currency pairs, sides, quotes and order sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Numeric value of a column, null where there is none (also for NaN)."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def parse_pair(c: Column) -> Column:
    """struct(base, quote) of EUR/USD, EURUSD or EUR_USD; null when it is not a pair."""
    s = F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("")))
    flat = F.replace(s, F.lit("_"), F.lit(""))
    slashed = s.rlike("^[A-Z]{3}/[A-Z]{3}$")
    return F.when(slashed, F.struct(F.substring(s, 1, 3).alias("base"), F.substring(s, 5, 3).alias("quote"))).when(
        flat.rlike("^[A-Z]{6}$"), F.struct(F.substring(flat, 1, 3).alias("base"), F.substring(flat, 4, 3).alias("quote"))
    )


def normal_pair(c: Column) -> Column:
    p = parse_pair(c)
    return F.when(p.isNotNull(), F.concat(p["base"], F.lit("/"), p["quote"])).otherwise(F.upper(F.trim(c)))


def pair_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def side_of_text(c: Column) -> Column:
    """buy or sell as the words say; null when they say neither or both."""
    t = F.lower(F.coalesce(c, F.lit("")))
    #: The words of each side.
    buy, sell = t.rlike(r"\bbuy\b|\blong\b|bullish|\bbull\b"), t.rlike(r"\bsell\b|\bshort\b|bearish|\bbear\b")
    up, down = t.rlike(r"\bup\b"), t.rlike(r"\bdown\b")
    return F.when((buy | up) & ~sell & ~down, F.lit("buy")).when((sell | down) & ~buy & ~up, F.lit("sell"))


def side(position: Column, recommendation: Column, pred_class: Column, p_buy: Column, p_sell: Column) -> Column:
    """The first rule that decides: position, recommendation, class number or text, larger probability."""
    n = number(pred_class)
    by_class = F.when(n == 1, "buy").when(n.isin(0, -1), "sell")
    by_text = F.when(n.isNull(), side_of_text(pred_class))
    b, s = number(p_buy), number(p_sell)
    return F.coalesce(side_of_text(position), side_of_text(recommendation), by_class, by_text, F.when(b > s, "buy").when(s > b, "sell"))


def expected_to_side(c: Column) -> Column:
    return F.when(c == "long", "buy").otherwise("sell")


def trade_hint(pct: Column) -> Column:
    return F.when(pct >= 90, "Spread very high").when(pct <= 10, "Spread very low").when(pct >= 70, "Spread high").when(pct <= 30, "Spread low").when(pct.isNotNull(), "Neutral").otherwise("")


def ellipsis(c: Column, width: int = 40) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("…"))).otherwise(c)


def bar_hours(interval: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in {"1m": 1 / 60, "5m": 5 / 60, "15m": 0.25, "1h": 1.0, "1d": 24.0}.items() for x in kv])
    return F.coalesce(table[interval], F.lit(5 / 60))


#: The share of a session's 390 minutes that has bars, and the other vendor's periods.
SESSION_MINUTES = 390 * 0.65
PERIODS = {"1m": "7d", "5m": "60d", "15m": "60d", "1h": "730d", "1d": "max"}


def lookback_days(interval: Column, n_bars: Column) -> Column:
    """Calendar days to ask for so that n bars of an interval are there, within the vendor's caps."""
    n = F.greatest(n_bars, F.lit(50))
    whole = lambda x: F.floor(x).cast("int")
    return (
        F.when(interval == "1d", F.least(whole(n * 1.5) + 10, F.lit(10950)))
        .when(interval == "1h", F.least(whole(n / 6.5) + 30, F.lit(1825)))
        .when(interval == "15m", F.least(whole(n * 15 / SESSION_MINUTES) + 10, F.lit(120)))
        .when(interval == "5m", F.least(whole(n * 5 / SESSION_MINUTES) + 10, F.lit(70)))
        .when(interval == "1m", F.least(F.greatest(F.lit(5), whole(n / SESSION_MINUTES) + 3), F.lit(10)))
        .otherwise(F.lit(60))
    )


def vendor_period(interval: Column) -> Column:
    """The period to ask the other vendor for, as it writes it."""
    table = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
    return F.coalesce(table[interval], F.lit("60d"))


def start_date(interval: Column, n_bars: Column, today: Column) -> Column:
    return F.date_sub(today, lookback_days(interval, n_bars).cast("int"))


def stop_rate(is_buy: Column, bid: Column, ask: Column, pct: Column, digits: Column) -> Column:
    p = F.greatest(pct / 100, F.lit(1e-11))
    raw, scale = F.when(is_buy, ask * (1 - p)).otherwise(bid * (1 + p)), F.pow(F.lit(10.0), F.greatest(digits, F.lit(1)))
    return F.round(raw * scale) / scale


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*(F.when(number(c) > 0, number(c)) for c in columns))


def order_amount(lots: Column, unit: Column, min_quantity: Column, max_quantity: Column, max_lots: float = 100.0) -> Column:
    """struct(amount, lots, error): whole lot steps, raised to the least and cut to the greatest quantity."""
    step = F.greatest(F.round(unit), F.lit(1.0))
    steps = F.floor(F.least(lots, F.lit(max_lots)) + 1e-9)
    amount = steps * step
    raised = F.when((min_quantity > 0) & (amount < min_quantity), F.ceil(min_quantity / step) * step).otherwise(amount)
    cut = F.when((max_quantity > 0) & (raised > max_quantity), F.greatest(step, F.floor(max_quantity / step) * step)).otherwise(raised)
    error = F.when((lots <= 0) | lots.isNull(), "no lots").when(steps < 1, "below one step").when((max_quantity > 0) & (cut > max_quantity), "above maximum")
    good = error.isNull()
    return F.struct(F.when(good, cut).alias("amount"), F.when(good, cut / step).alias("lots"), error.alias("error"))


def placeholder_quantity(equity: Column, pct: Column, leverage: Column, most: Column, divisor: Column) -> Column:
    d = F.when(divisor <= 0, F.lit(100.0)).otherwise(divisor)
    return F.least(F.greatest(F.bround(equity * pct / 100 * leverage / d), F.lit(1.0)), most)
