"""Quotes, conversions and order sizes; order lifecycles in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fx
from ..sources import files


def valid_quotes(quotes: DataFrame) -> DataFrame:
    ok = quotes.where("bid > 0 AND ask > 0 AND ask >= bid")
    return ok.withColumn("digits", F.least(F.greatest(F.coalesce("digits", F.lit(5)), F.lit(0)), F.lit(10)))


def resolve_offers(orders: DataFrame, quotes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Each order with its offer: that of an override (primary_pair, override) if there is one, else the pair's own.

    The best offer of each key is chosen first, subscribed ones preferred, so that orders are only looked up.
    """
    w = Window.partitionBy("_key").orderBy((F.col("subscription_status") == "T").desc_nulls_last(), "offer_idx")
    best = quotes.withColumn("_key", fx.pair_key(F.col("instrument"))).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("_key", F.struct(*quotes.columns).alias("_offer"))
    found = orders.withColumn("_key", fx.pair_key(F.col("primary_pair"))).join(best, "_key", "left")
    if overrides is not None:
        named = best.select(F.col("_key").alias("_other"), F.col("_offer").alias("_named"))
        found = found.join(overrides, "primary_pair", "left").withColumn("_other", fx.pair_key(F.col("override"))).join(named, "_other", "left").withColumn("_offer", F.coalesce("_named", "_offer")).drop("_other", "_named")
    out = found.select("*", "_offer.*").drop("_key", "_offer")
    status = F.when(F.col("instrument").isNull(), "no offer").when(F.col("subscription_status") != "T", "not subscribed")
    return out.withColumn("status_error", status)


def quote_edges(quotes: DataFrame) -> DataFrame:
    """a, b, m, e: an edge each way at the mid of a valid subscribed quote; e orders the quotes."""
    q = valid_quotes(quotes).where("subscription_status = 'T'").withColumn("p", fx.parse_pair(F.col("instrument"))).where("p IS NOT NULL AND p.base <> p.quote")
    mid = (F.col("bid") + F.col("ask")) / 2
    there = F.struct(F.col("p.base").alias("a"), F.col("p.quote").alias("b"), mid.alias("m"), F.col("offer_idx").alias("e"))
    back = F.struct(F.col("p.quote").alias("a"), F.col("p.base").alias("b"), (1 / mid).alias("m"), F.col("offer_idx").alias("e"))
    return q.select(F.inline(F.array(there, back)))


def conversions(quotes: DataFrame) -> DataFrame:
    """src, dst, hops, mult along the fewest quotes, of any number; among equal ones as a breadth-first search finds them.

    All sources are searched together: a round joins the currencies reached last with the edges, keeps those not
    reached before (by the place of the currency they come from, then by the quotes' order) and writes them, until a
    round reaches none. A source's state is one row a currency.
    """
    edges = files.kept(quote_edges(quotes), "edges")
    reached = edges.select(F.col("a").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"), F.lit(1.0).alias("mult"), F.lit(1).alias("place"))
    front = reached = files.kept(reached, "reached")
    while not front.isEmpty():
        steps = front.join(edges, front["dst"] == edges["a"]).select("src", F.col("b").alias("dst"), F.col("hops") + 1, F.col("mult") * F.col("m"), F.struct("place", "e").alias("way")).toDF("src", "dst", "hops", "mult", "way")
        first = steps.join(reached, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min(F.struct("way", "hops", "mult")).alias("best"))
        front = first.select("src", "dst", "best.hops", "best.mult", F.row_number().over(Window.partitionBy("src").orderBy("best.way")).alias("place"))
        front = files.kept(front, "front")
        reached = reached.unionByName(front)
    return reached.drop("place")


def convert(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts(src, dst, amount) with converted. One currency needs no rate and takes any amount; else there is an error
    where the amount is not positive and finite, or there is no path."""
    out = amounts.withColumns({"src": F.upper(F.trim("src")), "dst": F.upper(F.trim("dst"))}).join(rates, ["src", "dst"], "left")
    good = (F.col("amount") > 0) & (F.abs("amount") < float("inf"))
    error = F.when(F.col("src") == F.col("dst"), F.lit(None).cast("string")).when(F.coalesce(~good, F.lit(True)), "amount not positive").when(F.col("mult").isNull(), "no path")
    value = F.when(F.col("src") == F.col("dst"), F.col("amount")).otherwise(F.col("amount") * F.col("mult"))
    return out.withColumn("error", error).withColumn("converted", F.when(F.col("error").isNull(), value))


def account_equity(accounts: DataFrame) -> DataFrame:
    """equity_used: the first positive of the fields in order, else the assumed one; currency: three letters or USD."""
    names = [c for c in ("equity", "balance", "gross_pl", "usable_margin", "assumed_equity") if c in accounts.columns]
    equity = fx.first_positive(*(F.regexp_replace(F.col(c).cast("string"), ",", "") for c in names))
    money = F.upper(F.trim("currency"))
    return accounts.withColumns({"equity_used": equity, "money": F.when(money.rlike("^[A-Z]{3}$"), money).otherwise("USD"), "equity_error": F.when(equity.isNull(), "no equity")})


def size_basket(orders: DataFrame, accounts: DataFrame, quotes: DataFrame, rates: DataFrame, instruments: DataFrame, max_lots: float = 100.0) -> DataFrame:
    """Every leg with its amount, lots and stop, or the error that it failed with; one failure stops nothing else."""
    offers = resolve_offers(orders, quotes).drop("instrument").join(account_equity(accounts), "account_id", "left")
    base = fx.parse_pair(F.col("primary_pair"))["base"]
    o = offers.withColumn("_base", base).join(rates.select(F.col("src").alias("money"), F.col("dst").alias("_base"), "mult"), ["money", "_base"], "left").join(instruments.withColumnRenamed("instrument", "primary_pair"), "primary_pair", "left")
    notional = F.col("equity_used") * F.col("pct_equity") / 100 * F.greatest("leverage", F.lit(1e-9)) * F.when(F.col("money") == F.col("_base"), 1.0).otherwise(F.col("mult"))
    lots = F.coalesce("lots", notional / F.col("base_unit_size"))
    sized = o.withColumn("size", fx.order_amount(lots, F.col("base_unit_size"), F.col("min_quantity"), F.col("max_quantity"), max_lots))
    bad = ~((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")))
    error = F.coalesce("status_error", F.when(F.coalesce(bad, F.lit(True)), "bad quote"), "equity_error", F.when(F.col("lots").isNull() & notional.isNull(), "no conversion"), "size.error")
    stop = fx.stop_rate(F.col("is_buy"), F.col("bid"), F.col("ask"), F.col("stop_loss_pct"), F.least(F.greatest(F.coalesce("digits", F.lit(5)), F.lit(0)), F.lit(10)))
    good = error.isNull()
    return sized.select("order_id", "primary_pair", "is_buy", F.when(good, F.col("size.amount")).alias("amount"), F.when(good, F.col("size.lots")).alias("lots"), F.when(good, stop).alias("stop_rate"), error.alias("error"))


def stage_times(events: DataFrame, *keys: Column) -> DataFrame:
    """order_id (and keys) with the first times, in microseconds, of added (a), changed (c), deleted (d), and has_trade."""
    at = lambda k: F.min(F.when(F.col("kind") == k, F.unix_micros(F.col("ts").cast("timestamp"))))
    return events.groupBy("order_id", *keys).agg(at("added").alias("a"), at("changed").alias("c"), at("deleted").alias("d"), F.max(F.when(F.col("kind") == "trade", 1)).isNotNull().alias("has_trade"))


def verdicts(times: DataFrame, timeout_seconds: float = 30.0) -> DataFrame:
    gap = lambda x, y: F.coalesce((F.col(y) - F.col(x)) <= timeout_seconds * 1e6, F.lit(False))
    return times.select("order_id", F.when(gap("a", "c") & gap("c", "d"), "complete").otherwise("timeout").alias("status"), "has_trade")


def lifecycle(events: DataFrame, timeout_seconds: float = 30.0) -> DataFrame:
    """order_id, status: complete when added, changed and deleted follow within the timeout of each stage, else timeout."""
    return verdicts(stage_times(events), timeout_seconds)
