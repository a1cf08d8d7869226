"""Operators on daily direction signals: classify, fan out to currencies, score and summarise, by forecast date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fx

#: The columns that are shown, in order.
DISPLAY = ("primary_pair", "recommendation", "position", "pred_class", "p_buy", "p_sell", "avg_oos_accuracy", "binary_oos_sharpe")
STRONG = 0.65
#: The pair that stands for a base currency.
PREFERRED = {"EUR": "EUR/USD", "GBP": "GBP/USD", "AUD": "AUD/USD", "NZD": "NZD/USD", "USD": "USD/JPY"}
#: Pairs of a universe at most.
PAIRS_LIMIT = 10_000


def classified(signals: DataFrame) -> DataFrame:
    side = fx.side(*(F.col(c) for c in ("position", "recommendation", "pred_class", "p_buy", "p_sell")))
    return signals.withColumn("side", side)


def accurate(signals: DataFrame, least: float) -> DataFrame:
    return signals.where(fx.number(F.col("avg_oos_accuracy")) >= least)


def close_basis(signals: DataFrame) -> DataFrame:
    return signals.where(F.lower("target_return_basis") == "close")


def strong(signals: DataFrame) -> DataFrame:
    """Signals of at least the strong accuracy, on a close basis."""
    return close_basis(accurate(signals, STRONG))


def for_display(signals: DataFrame, least: float = 0.60) -> DataFrame:
    kept = accurate(signals, least)
    known = [c for c in DISPLAY if c in kept.columns]
    return kept.orderBy(F.desc_nulls_last("avg_oos_accuracy"), F.desc_nulls_last("binary_oos_sharpe")).select(*[c for c in kept.columns if c in ("event_id", "forecast_date")], *known)


def currency_legs(signals: DataFrame, *keys: str) -> DataFrame:
    """Per currency (and keys): n_long, n_short, n_total, score, dominant. Unclassified rows have no leg."""
    s = classified(signals).withColumn("p", fx.parse_pair(F.col("primary_pair"))).where("side IS NOT NULL AND p IS NOT NULL")
    buy = F.col("side") == "buy"
    legs = F.explode(F.array(F.struct(F.col("p.base").alias("currency"), buy.alias("long")), F.struct(F.col("p.quote").alias("currency"), (~buy).alias("long"))))
    out = s.select(*keys, legs.alias("leg")).groupBy(*keys, "leg.currency").agg(F.count_if("leg.long").alias("n_long"), F.count_if(~F.col("leg.long")).alias("n_short"), F.count("*").alias("n_total"))
    d = F.col("n_long") - F.col("n_short")
    return out.withColumns({"score": d / F.col("n_total"), "dominant": F.when(d > 0, "long").when(d < 0, "short").otherwise("tie")})


def _pairs(universe: DataFrame) -> list:
    """The universe's pairs that have two currencies: a list of at most PAIRS_LIMIT, else an error."""
    p = fx.parse_pair(F.col("primary_pair"))
    rows = universe.withColumn("p", p).where("p IS NOT NULL").select("universe_idx", "primary_pair", F.col("p.base").alias("base"), F.col("p.quote").alias("quote")).limit(PAIRS_LIMIT + 1).collect()
    if len(rows) > PAIRS_LIMIT:
        raise ValueError(f"a universe has at most {PAIRS_LIMIT} pairs")
    return rows


def pair_scores(legs: DataFrame, universe: DataFrame, *keys: str) -> DataFrame:
    """Every pair of the universe with base - quote score; a currency without signals scores 0.

    A date's currencies are one map, the universe one array: its pairs are unfolded and looked up without a join.
    """
    rows = _pairs(universe)
    kinds = {f.name: f.dataType for f in universe.schema.fields}
    item = lambda r: F.struct(F.lit(r["universe_idx"]).cast(kinds["universe_idx"]).alias("universe_idx"), *(F.lit(r[c]).alias(c) for c in ("primary_pair", "base", "quote")))
    pairs = F.array(*map(item, rows)) if rows else F.array().cast(f"array<struct<universe_idx:{kinds['universe_idx'].simpleString()},primary_pair:string,base:string,quote:string>>")
    known = legs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("currency", "score"))).alias("_s"))
    out = known.select(*keys, "_s", F.inline(pairs))
    out = out.withColumns({f"{leg}_score": F.coalesce(F.try_element_at("_s", F.col(leg)), F.lit(0.0)) for leg in ("base", "quote")}).drop("_s")
    raw = F.col("base_score") - F.col("quote_score")
    side = F.when(raw > 1e-9, "long").when(raw < -1e-9, "short").otherwise("neutral")
    return out.select(*keys, "universe_idx", "primary_pair", "base", "quote", F.round("base_score", 4).alias("base_score"), F.round("quote_score", 4).alias("quote_score"), F.round(raw, 4).alias("pair_score"), side.alias("expected_side"))


def side_counts(signals: DataFrame) -> DataFrame:
    return classified(signals).groupBy("primary_pair").pivot("side", ["buy", "sell"]).agg(F.count(F.lit(1))).na.fill(0, ["buy", "sell"])


def majority_side(signals: DataFrame) -> DataFrame:
    """primary_pair, signal_side (long or short): the more frequent one; long on a tie."""
    n = classified(signals).where("side IS NOT NULL").groupBy("primary_pair").agg(F.count_if(F.col("side") == "buy").alias("b"), F.count_if(F.col("side") == "sell").alias("s"))
    return n.select("primary_pair", F.when(F.col("b") >= F.col("s"), "long").otherwise("short").alias("signal_side"))


def likelihood(scores: DataFrame, majority: DataFrame) -> DataFrame:
    out = scores.join(majority, "primary_pair", "left").withColumn("signal_side", F.coalesce("signal_side", F.lit("")))
    return out.withColumn("agrees", (F.col("signal_side") != "") & (F.col("signal_side") == F.col("expected_side")))


def kpis(signals: DataFrame) -> DataFrame:
    low, high = F.min("forecast_date"), F.max("forecast_date")
    span = F.when(low == high, low).otherwise(F.concat(low, F.lit(" to "), high))
    return signals.agg(F.count("*").alias("n_rows"), F.count_if(F.col("avg_oos_accuracy") >= STRONG).alias("n_strong"), F.countDistinct("primary_pair").alias("n_pairs"), span.alias("dates"))


def modal_date(signals: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """forecast_date: the most frequent date, the smallest on a tie; where no row has a date, the metadata's value of
    target_forecast_date, its key in any case."""
    day = F.date_format(F.col("forecast_date").cast("string").try_cast("date"), "yyyy-MM-dd")
    n = signals.select(day.alias("forecast_date")).where("forecast_date IS NOT NULL").groupBy("forecast_date").count()
    best = n.orderBy(F.desc("count"), "forecast_date").limit(1).select("forecast_date", F.lit(0).alias("o"))
    if metadata is not None:
        best = best.union(metadata.where(F.lower("key") == "target_forecast_date").select(F.col("value").cast("string"), F.lit(1)))
    return best.orderBy("o").limit(1).select("forecast_date")


def bias_orders(legs: DataFrame, universe: DataFrame, *keys: str) -> DataFrame:
    """One order for each currency with a bias: the pair that expresses it, and whether to buy it."""
    p = universe.withColumn("p", fx.parse_pair(F.col("primary_pair"))).where("p IS NOT NULL")
    preferred = F.create_map(*[F.lit(x) for kv in PREFERRED.items() for x in kv])
    base = p.groupBy(F.col("p.base").alias("currency")).agg(F.min("primary_pair").alias("low"), F.max(F.when(F.col("primary_pair") == preferred[F.col("p.base")], F.col("primary_pair"))).alias("best")).select("currency", F.coalesce("best", "low").alias("pair"), F.lit(True).alias("as_base"))
    quote = p.groupBy(F.col("p.quote").alias("currency")).agg(F.min("primary_pair").alias("pair")).join(base, "currency", "left_anti").withColumn("as_base", F.lit(False))
    table = base.unionByName(quote)  # one row a currency
    out = legs.where("dominant IN ('long', 'short')").join(table, "currency")
    return out.select(*keys, "currency", "dominant", "pair", ((F.col("dominant") == "long") == F.col("as_base")).alias("buy"))


def ranking(signals: DataFrame, universe: DataFrame, least: float = 0.55, *keys: str) -> DataFrame:
    """Pairs by |pair_score|; ties by pair_score, then the universe's order; neutral pairs are left out."""
    scores = pair_scores(currency_legs(accurate(signals, least), *keys), universe, *keys).where("expected_side <> 'neutral'")
    scores = scores.withColumn("abs_score", F.abs("pair_score"))
    order = (F.desc("abs_score"), F.col("pair_score"), F.col("universe_idx"))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(*order)  # one row a pair of the universe
    return scores.withColumn("rank", F.row_number().over(w))
