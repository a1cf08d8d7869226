"""Operators on bars(symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fx

PAYLOAD = "struct<error:string,results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>>"


def flatten_payloads(landed: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of landed JSON aggregates: no rows where there is an error; a missing volume is 0; New York time."""
    rows = landed.withColumn("p", F.from_json("payload", PAYLOAD)).where("p.error IS NULL").select("symbol", F.inline("p.results"))
    ts = F.from_utc_timestamp(F.timestamp_millis("t"), "America/New_York")
    out = rows.select(normal_symbol("symbol").alias("symbol"), ts.alias("ts"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.coalesce("v", F.lit(0.0)).alias("volume"))
    day = F.to_date("ts")
    return out.where((day >= F.lit(start) if start else F.lit(True)) & (day <= F.lit(end) if end else F.lit(True)))


def normal_symbol(name: str):
    return F.replace(F.upper(F.trim(F.col(name))), F.lit("-"), F.lit("."))


def of_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def last_days(bars: DataFrame, days: int) -> DataFrame:
    latest = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    return bars.join(latest, "symbol").where(F.col("ts") >= F.col("_last") - F.make_interval(days=F.lit(days))).drop("_last")


def last_bars(bars: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def at_least(bars: DataFrame, n: int) -> DataFrame:
    enough = bars.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("symbol")
    return bars.join(enough, "symbol", "left_semi")


def average_daily_volume(daily: DataFrame, n: int = 30, least: int = 10) -> DataFrame:
    """symbol, adv: the mean of the last n volumes; null below `least` values."""
    known = daily.where(F.col("volume").isNotNull())
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    ranked = known.select("symbol", "volume", F.row_number().over(w).alias("k"))
    return ranked.groupBy("symbol").agg(F.when(F.count("*") >= least, F.avg(F.when(F.col("k") <= n, F.col("volume")))).alias("adv"))


def volume_sum(daily: DataFrame, days: int = 20) -> DataFrame:
    return last_days(daily, days).groupBy("symbol").agg(F.sum(F.coalesce("volume", F.lit(0.0))).alias("adv"))


def grouped(symbols: DataFrame, groups: DataFrame) -> DataFrame:
    out = symbols.join(groups, "symbol", "left")
    return out.withColumn("group_id", F.coalesce("group_id", F.concat(F.lit("asset:"), "symbol")))


def diverse_top(scores: DataFrame, groups: DataFrame, n: int = 100) -> DataFrame:
    """rank, symbol, group_id, adv: the best of each group, then the n best (ties: symbol)."""
    best = Window.partitionBy("group_id").orderBy(F.desc("adv"), "symbol")
    top = grouped(scores, groups).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").orderBy(F.desc("adv"), "symbol").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("adv"), "symbol")))  # at most n rows


def rank_by_volume(daily: DataFrame, groups: DataFrame, n: int = 100) -> DataFrame:
    return diverse_top(average_daily_volume(daily).where("adv > 0"), groups, n)


def macro_choice(bars: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """label, symbol, n_bars, last_close: the first candidate with enough bars, else the longest, else the first."""
    size = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max_by("close", "ts").alias("last_close"))
    known = candidates.join(size, "symbol", "left").withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))
    meets = F.col("n_bars") >= least
    w = Window.partitionBy("label").orderBy(meets.desc(), F.when(meets, F.col("cand_idx")), F.desc("n_bars"), "cand_idx")
    return known.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("label", "symbol", "n_bars", "last_close")


def day_aligned(bars: DataFrame, a: str, b: str, least: int = 60) -> DataFrame:
    """day, ly, lx: log closes of two symbols on common days, the first row of each day; none below `least` days."""
    w = Window.partitionBy("symbol", "day").orderBy("ts")
    first = bars.where(F.col("symbol").isin(a, b)).withColumn("day", F.to_date("ts")).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    one, two = (first.where(F.col("symbol") == s).select("day", F.ln("close").alias(n)) for s, n in ((a, "ly"), (b, "lx")))
    both = one.join(two, "day").where("ly IS NOT NULL AND lx IS NOT NULL")
    # one row a day at most
    return both.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).where(F.col("_n") >= least).drop("_n")


def load_universe(bars: DataFrame, daily: DataFrame, groups: DataFrame, presets: DataFrame, seed: DataFrame, macro: DataFrame, interval: str, n_bars: int = 1000, top: int = 100) -> dict[str, DataFrame]:
    """What a run starts from: `top`, the ranked symbols, one a group; `etf_raw`, the last n bars of these and of the
    presets' symbols, as far as the seed has them; `etf_top`, those of the ranked ones; `macro`, the last n bars of
    each label's candidate; `macro_resolved`, the candidates; `settings`, one row with the interval, the period and n."""
    n = max(50, n_bars)
    ranked = rank_by_volume(daily, groups, top)
    names = ranked.select("symbol").union(presets.select("sym_a")).union(presets.select("sym_b")).distinct().join(seed.select("symbol").distinct(), "symbol", "left_semi")
    raw = last_bars(of_universe(bars, names), n)
    chosen = macro_choice(bars, macro, max(50, min(500, n // 2)))
    known = chosen.select("label", "symbol")
    settings = bars.sparkSession.range(1).select(F.lit(interval).alias("bar_interval"), fx.vendor_period(F.lit(interval)).alias("bar_period"), F.lit(n).alias("n_bars"))
    return {"top": ranked, "etf_raw": raw, "etf_top": of_universe(raw, ranked), "macro": last_bars(bars.join(known, "symbol"), n, "label"), "macro_resolved": known, "settings": settings}


#: Series for which the vendor has no symbol, each with its note.
PLACEHOLDERS = {
    "spx_rr_35d_call_put_vol": "N/A — not on Yahoo Finance (use CBOE / prime broker options surface)",
    "spx_rr_25d_call_put_vol": "N/A — not on Yahoo Finance",
    "spx_rr_15d_call_put_vol": "N/A — not on Yahoo Finance",
    "spx_rr_10d_call_put_vol": "N/A — not on Yahoo Finance",
    "spx_rr_5d_call_put_vol": "N/A — not on Yahoo Finance",
}


def placeholder_status(spark: SparkSession) -> DataFrame:
    """series, yahoo_symbol (null), note."""
    return spark.createDataFrame([(k, None, v) for k, v in PLACEHOLDERS.items()], "series string, yahoo_symbol string, note string")
