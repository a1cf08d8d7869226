"""Preset pairs: bind legs to ranked representatives, test them, gate and order them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from . import bars as B
from . import gram as G
from . import pairs as P
from . import stats as S

SCREEN_BARS = 150


def bind_legs(presets: DataFrame, ranked: DataFrame, groups: DataFrame, bars: DataFrame) -> DataFrame:
    """presets with y, x, lead, follow: each symbol if ranked, else the best ranked one of its group; else the pair goes."""
    by_group = ranked.groupBy("group_id").agg(F.min_by("symbol", "rank").alias("best"))
    legs = {"sym_a": "y", "sym_b": "x", "leader": "lead", "follower": "follow"}
    out = presets
    for source, name in legs.items():
        symbols = B.grouped(presets.select(F.col(source).alias("symbol")).distinct(), groups)
        exact = ranked.select(F.col("symbol").alias("_s"), F.lit(True).alias("_in"))
        found = symbols.join(exact, symbols["symbol"] == exact["_s"], "left").join(by_group, "group_id", "left")
        found = found.select(F.col("symbol").alias(source), F.when(F.col("_in"), F.col("symbol")).otherwise(F.col("best")).alias(name))
        out = out.join(found, source, "left")
    have = bars.select("symbol").distinct()
    out = out.where("y IS NOT NULL AND x IS NOT NULL AND lead IS NOT NULL AND follow IS NOT NULL AND y <> x")
    for leg in ("y", "x"):
        out = out.join(have.withColumnRenamed("symbol", leg), leg, "left_semi")
    return out


def screen(bars: DataFrame, presets: DataFrame, ranked: DataFrame, groups: DataFrame, hours_per_bar: float, least: int = 30, p_limit: float = 0.05, half_life: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """The table of screened presets: z over the full window, tests on the last SCREEN_BARS bars, passes first."""
    bound = files.kept(bind_legs(presets, ranked, groups, bars), "bound")  # one row a preset
    # both directions of a pair, so that each preset finds its own
    wanted = bound.select("y", "x").union(bound.select(F.col("follow").alias("y"), F.col("lead").alias("x"))).where("y <> x").distinct()
    both = G.rows_of(bars, wanted).withColumn("_n", F.count("*").over(Window.partitionBy("y", "x"))).where(F.col("_n") >= least).drop("_n")
    both = files.kept(both, "legs")  # four statistics need it
    full = P.fit_stats(P.spreads(both)).select("y", "x", "z", "signal", "beta")
    last = both.withColumn("_k", F.row_number().over(Window.partitionBy("y", "x").orderBy(F.desc("ts")))).where(F.col("_k") <= SCREEN_BARS).drop("_k")
    recent = P.fit_stats(P.spreads(last)).select("y", "x", "half_life_bars")
    tests = S.cointegration(last, SCREEN_BARS).select("y", "x", "pvalue")
    lead = S.granger(P.returns(both, SCREEN_BARS)).select(F.col("y").alias("follow"), F.col("x").alias("lead"), "granger_p")
    days = F.col("half_life_bars") * hours_per_bar / 24
    out = bound.join(full, ["y", "x"]).join(recent, ["y", "x"], "left").join(tests, ["y", "x"], "left").join(lead, ["follow", "lead"], "left")
    out = out.withColumns({"pvalue": F.coalesce(F.nanvl("pvalue", F.lit(1.0)), F.lit(1.0)), "half_life_days": days})
    gates = {"pass_coint": F.col("pvalue") < p_limit, "pass_granger": F.coalesce(F.col("granger_p") < p_limit, F.lit(False)), "pass_half_life": F.coalesce(F.col("half_life_days").between(*half_life), F.lit(False))}
    out = out.withColumns(gates).withColumn("passed", F.col("pass_coint") & F.col("pass_granger") & F.col("pass_half_life"))
    return out.select("preset_idx", "category", "y", "x", F.col("lead").alias("leader"), F.col("follow").alias("follower"), "beta", "pvalue", "granger_p", "half_life_days", "z", "signal", *gates, "passed").orderBy(F.desc("passed"), "pvalue", "preset_idx")


def scan(bars: DataFrame, groups: DataFrame, days: int = 60, least: int = 1500, p_limit: float = 0.05, n: int = 200, events: int = 3) -> DataFrame:
    """The all-pairs scan: gates from Gram products before any pair row, the test on their survivors, episodes and
    statistics on its own; ordered by p, then y, x."""
    recent = files.kept(B.at_least(B.last_days(bars, days), least).select("symbol", "ts", "close"), "recent")
    pairs = files.kept(G.fits(recent, groups, least).where("NOT near_duplicate"), "fits")  # one row a pair
    longest = G.longest(pairs)
    tests = files.kept(S.cointegration(G.fitted(recent, pairs), longest).where(F.col("pvalue") <= p_limit), "tests")
    rows = files.kept(G.fitted(recent, pairs.join(tests, list(P.KEY), "left_semi")), "rows")
    moves = P.episode_summary(P.episodes(rows, longest=longest)).where((F.col("n_high") >= events) & (F.col("n_low") >= events))
    return P.fit_stats(rows, longest).join(tests, ["y", "x"]).join(moves, ["y", "x"]).orderBy("pvalue", "y", "x").limit(n)
