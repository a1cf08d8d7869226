"""Pair statistics before pairs: tiled Gram products of the symbol x time matrix.

Times are dealt into slices and symbols into tiles by hash; a task holds the log closes of two tiles in one slice as
matrices (rows are times, missing bars are 0 under a mask) and multiplies them, which gives for each pair of symbols
the count of common bars and the sums of y, x, yy, xx and xy over them. Slices are added up. From these follow n, the
hedge ratio, the correlation and the near-duplicate test, so that pair rows are only built for the pairs that are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("y", "x")
#: A task holds (symbols / TILES) x (times / SLICES) cells of two tiles and (symbols / TILES)^2 sums; raise them for
#: more than some thousands of symbols or a hundred thousand times.
TILES, SLICES = 4, 4
SUMS = ("n", "sy", "sx", "syy", "sxx", "sxy")
#: The share of its sum of squares below which a variance is rounding and the series is constant.
ROUNDING = 1e-13


def logs(bars: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """symbol, ts, l (log close), g (the group, or the symbol itself) of the bars with a close."""
    side = bars.where("close > 0").select("symbol", "ts", F.ln("close").alias("l"))
    if groups is None:
        return side.withColumn("g", F.col("symbol"))
    return side.join(groups, "symbol", "left").withColumn("g", F.coalesce("group_id", F.concat(F.lit("asset:"), "symbol"))).drop("group_id")


def _multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slice of two tiles: the sums of every pair of symbols, each pair once."""
    symbols, at = np.unique(pdf["symbol"].to_numpy(dtype=str), return_inverse=True)
    times, row = np.unique(pdf["ts"].to_numpy(), return_inverse=True)
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    tile = np.zeros(len(symbols), dtype=np.int64)
    tile[at] = pdf["tile"].to_numpy()
    value, known = np.zeros((len(times), len(symbols))), np.zeros((len(times), len(symbols)))
    value[row, at], known[row, at] = pdf["l"].to_numpy(), 1.0
    a, b = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    v, w, k, m = value[:, a], value[:, b], known[:, a], known[:, b]
    out = {"n": k.T @ m, "sy": v.T @ m, "sx": k.T @ w, "syy": (v * v).T @ m, "sxx": k.T @ (w * w), "sxy": v.T @ w}
    i, j = np.nonzero(out["n"] * ((symbols[a][:, None] < symbols[b]) if low == high else 1.0))
    y, x = symbols[a[i]], symbols[b[j]]
    sums = {c: s[i, j] for c, s in out.items()}
    swap = y > x  # tiles are not in the symbols' order
    y, x = np.where(swap, x, y), np.where(swap, y, x)
    for c, d in (("sy", "sx"), ("syy", "sxx")):
        sums[c], sums[d] = np.where(swap, sums[d], sums[c]), np.where(swap, sums[c], sums[d])
    return pd.DataFrame({"y": y, "x": x, **sums})


def products(side: DataFrame, tiles: int = TILES, slices: int = SLICES) -> DataFrame:
    """y, x, SUMS of rows symbol, ts, l (unique by symbol and ts), y < x, over the times that both have."""
    tile = F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int")
    rows = side.select("symbol", "ts", "l", tile.alias("tile"), F.pmod(F.xxhash64("ts"), F.lit(slices)).cast("int").alias("slice"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    parts = rows.groupBy("slice", "low", "high").applyInPandas(_multiplied, "y string, x string, " + ", ".join(f"{c} double" for c in SUMS))
    return parts.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS))


def centred(total: str, square: str, n: Column) -> Column:
    """The sum of squares about the mean; 0 where it is no more than rounding."""
    c = F.col(square) - F.col(total) * F.col(total) / n
    return F.when(c > ROUNDING * F.col(square), c).otherwise(0.0)


def fits(bars: DataFrame, groups: DataFrame | None = None, least: int = 30) -> DataFrame:
    """y, x, n, alpha, beta, total (sum of squares of y), r, near_duplicate of the pairs of different groups with at
    least `least` common bars and a slope: the gates that need no pair row."""
    side = logs(bars, groups)
    # about each symbol's own mean, so that sums of squares lose nothing
    side = side.withColumn("m", F.avg("l").over(Window.partitionBy("symbol")))
    sums = products(side.withColumn("l", F.col("l") - F.col("m"))).where(F.col("n") >= least)
    names = side.groupBy("symbol").agg(F.first("m").alias("m"), F.first("g").alias("g"))
    for k in KEY:
        sums = sums.join(names.select(F.col("symbol").alias(k), F.col("m").alias(f"m{k}"), F.col("g").alias(f"g{k}")), k)
    n = F.col("n")
    cov = F.col("sxy") - F.col("sy") * F.col("sx") / n
    d = sums.where("gy <> gx").withColumns({"cyy": centred("sy", "syy", n), "cxx": centred("sx", "sxx", n), "cxy": cov}).where("cxx > 0")
    beta = F.col("cxy") / F.col("cxx")
    alpha = F.col("my") + F.col("sy") / n - F.col("beta") * (F.col("mx") + F.col("sx") / n)
    r = F.try_divide(F.col("cxy"), F.sqrt(F.col("cyy") * F.col("cxx")))
    flat = (F.sqrt(F.col("cyy") / n) < 1e-12) | (F.sqrt(F.col("cxx") / n) < 1e-12)
    near = (F.abs(F.col("beta") - 1) < 0.04) & (n >= 10) & (flat | F.coalesce(F.col("r") >= 0.997, F.lit(False)))
    d = d.withColumns({"beta": beta, "r": r}).withColumns({"alpha": alpha, "near_duplicate": near})
    return d.select(*KEY, n.cast("long").alias("n"), "alpha", "beta", F.col("cyy").alias("total"), "r", "near_duplicate")


def rows_of(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """y, x, ts, ly, lx and the pairs' other columns: the common bars of these pairs alone.

    Each pair asks for its two legs by symbol (bars in buckets of symbols are not shuffled for that), legs meet by pair,
    in the one shuffle of pair rows there is: windows and aggregates by pair that follow need none.
    """
    more = [c for c in pairs.columns if c not in KEY]
    leg = lambda c: F.struct(F.col(c).alias("symbol"), F.lit(c == "y").alias("_y"))
    asked = pairs.select(*pairs.columns, F.inline(F.array(leg("y"), leg("x"))))
    both = asked.join(bars.where("close > 0").select("symbol", "ts", F.ln("close").alias("_l")), "symbol").repartition(*KEY)
    side = lambda own: F.max(F.when(F.col("_y") == F.lit(own), F.col("_l")))
    met = both.groupBy(*KEY, "ts").agg(side(True).alias("ly"), side(False).alias("lx"), *(F.first(c).alias(c) for c in more))
    return met.where("ly IS NOT NULL AND lx IS NOT NULL")


def fitted(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of fitted pairs (a table of fits()) with their spread; they are built for no other pair."""
    return rows_of(bars, pairs.select(*KEY, "alpha", "beta")).withColumn("spread", F.col("ly") - (F.col("alpha") + F.col("beta") * F.col("lx")))


def longest(pairs: DataFrame) -> int:
    """The rows of the longest of fitted pairs (one number)."""
    return pairs.agg(F.max("n")).head()[0] or 1
