"""The tests of a pair, all of it aggregates and expressions: one state a pair, no grouped Python.

Engle-Granger: ADF without constant on the residuals, lag by AIC, p from MacKinnon's response surface for two
variables with a constant. Granger: the SSR F-test for each lag, smallest p.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import moments as M

#: MacKinnon (1994), two variables, constant: small and large p surfaces and their limits.
SMALL_P = (2.92, 1.5012, 0.039796)
LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)
TAU_MIN, TAU_STAR, TAU_MAX = -18.86, -2.62, 0.92
#: The share of the variance left unexplained up to which two series count as one: 100 times the root of double rounding.
COLLINEAR = 100 * math.sqrt(2.0**-52)
KEY = ("y", "x")


def mackinnon_p(tau: Column) -> Column:
    surface = lambda c: sum((F.lit(v) * tau**k for k, v in enumerate(c)), F.lit(0.0))
    inner = F.when(tau <= TAU_STAR, surface(SMALL_P)).otherwise(surface(LARGE_P))
    return F.when(tau > TAU_MAX, 1.0).when(tau < TAU_MIN, 0.0).otherwise(M.normal_cdf(inner))


def most_lags(n: Column) -> Column:
    """Schwert's rule, kept below half the rows."""
    return F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 1).cast("int")


def adf(residuals: DataFrame, longest: int) -> DataFrame:
    """y, x, n, lags, tau of rows y, x, ts, spread, for pairs of at least four rows; longest: those of the longest pair.

    Variables: the level e_t, then the differences d_(t-1), ..., d_(t-L), against d_t. Every lag order is judged on the
    rows that the largest one has; the chosen one is fitted again on all its own rows.
    """
    top = max(1, math.ceil(12 * (longest / 100) ** 0.25))
    w = Window.partitionBy(*KEY).orderBy("ts")
    rows = residuals.select(*KEY, "ts", F.col("spread").alias("e"), (F.lead("spread").over(w) - F.col("spread")).alias("d")).where("d IS NOT NULL")
    state = M.lag_moments(rows, KEY, "ts", ("e", "d"), top)
    n = F.col("rows") + 1
    state = state.where("rows >= 3").withColumn("n", n).withColumn("most", most_lags(F.col("n")))
    level, target = M.variables((0, 0)), M.variables((1, 0))

    def last(vs: Column, drop: Column) -> Column:
        """The factor's last row with the sum of squares it stands for."""
        return M.let(M.matrix(vs, drop, 2), lambda m: F.struct(F.element_at(M.factor(m), -1).alias("c"), F.element_at(F.element_at(m, -1), -1).alias("yy")))

    every = last(F.concat(level, M.lagged(1, F.col("most")), target), F.col("most"))
    used = F.col("n") - 1 - F.col("most")
    left = M.let(every, lambda f: F.slice(M.nested(f["c"], f["yy"]), 2, F.col("most") + 1))
    aic = F.transform(left, lambda s, k: F.struct((used * F.ln(F.greatest(s, F.lit(1e-300)) / used) + 2 * (k + 1)).alias("aic"), k.alias("lags")))
    chosen = state.withColumn("lags", F.array_min(aic)["lags"])
    own = last(F.concat(M.lagged(1, F.col("lags")), level, target), F.col("lags"))

    def tau(f: Column) -> Column:
        rest = F.element_at(M.nested(f["c"], f["yy"]), -1) / (F.col("n") - 1 - F.col("lags") - F.col("lags") - 1)
        return F.when(rest > 0, F.get(f["c"], F.col("lags")) / F.sqrt(rest)).otherwise(float("-inf"))

    return chosen.select(*KEY, "n", "lags", M.let(own, tau).alias("tau"))


def cointegration(pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """y, x, coint_t, pvalue of rows y, x, ts, ly, lx. longest: the rows of the longest pair, counted if not given.

    A pair whose fit leaves no more than COLLINEAR of ly's variance, or a constant ly, has statistic -inf and p 0. A pair
    of fewer than four rows has no row.
    """
    w = Window.partitionBy(*KEY)
    d = pairs if "spread" in pairs.columns else pairs.withColumns({"_b": F.regr_slope("ly", "lx").over(w), "_a": F.regr_intercept("ly", "lx").over(w)}).withColumn("spread", F.col("ly") - (F.coalesce(F.col("_a") + F.col("_b") * F.col("lx"), F.avg("ly").over(w))))
    if longest is None:
        longest = d.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 1  # one number
    fit = d.groupBy(*KEY).agg((F.count("*") * F.var_pop("ly")).alias("total"), F.sum(F.col("spread") * F.col("spread")).alias("ssr"))
    out = adf(d, longest).join(fit, list(KEY))
    tau = F.when((F.col("total") == 0) | (F.col("ssr") / F.col("total") <= COLLINEAR), float("-inf")).otherwise(F.col("tau"))
    return out.withColumn("coint_t", tau).select(*KEY, "coint_t", mackinnon_p(F.col("coint_t")).alias("pvalue"))


def granger(rets: DataFrame, max_lag: int = 5) -> DataFrame:
    """y, x, granger_p: does x lead y? on the returns ry and rx, the least p of the lags up to max_lag.

    Each lag order has its own rows. With the constant first, then the follower's lags, then the leader's, one factor
    holds the restricted and the full model. Null below max_lag + 15 rows.
    """
    state = M.lag_moments(rets.withColumn("one", F.lit(1.0)), KEY, "ts", ("one", "ry", "rx"), max_lag)
    n = F.col("rows")

    def p(lag: Column) -> Column:
        vs = F.concat(M.variables((0, 0)), M.lagged(1, lag), M.lagged(2, lag), M.variables((1, 0)))

        def of(m: Column) -> Column:
            left = M.nested(F.element_at(M.factor(m), -1), F.element_at(F.element_at(m, -1), -1))

            def test(s: Column) -> Column:
                small, full, free = F.get(s, lag + 1), F.get(s, 2 * lag + 1), n - lag - 2 * lag - 1
                return F.when((free > 0) & (full > 0), M.f_survival((small - full) / lag / (full / free), lag, free))

            return M.let(left, test)

        return M.let(M.matrix(vs, lag, 3), of)

    lags = F.sequence(F.lit(1), F.least(F.lit(max_lag), F.greatest(F.lit(1), F.floor(n / 10))).cast("int"))
    least = F.array_min(F.transform(lags, p))
    return state.select(*KEY, F.when(n >= max_lag + 15, least).alias("granger_p"))


def dickey_fuller_lag0(fitted: DataFrame) -> DataFrame:
    """y, x, df_t: the lag-0 statistic of the spread in plain aggregates."""
    w = Window.partitionBy("y", "x").orderBy("ts")
    d = fitted.withColumn("e1", F.lag("spread").over(w)).where("e1 IS NOT NULL").withColumn("de", F.col("spread") - F.col("e1"))
    a = d.groupBy("y", "x").agg(F.sum(F.col("e1") * F.col("de")).alias("sxy"), F.sum(F.col("e1") * F.col("e1")).alias("sxx"), F.sum(F.col("de") * F.col("de")).alias("syy"), F.count("*").alias("n"))
    b = F.try_divide("sxy", "sxx")
    scale = (F.col("syy") - b * F.col("sxy")) / (F.col("n") - 1)
    return a.where("n > 1").select("y", "x", (b / F.sqrt(scale / F.col("sxx"))).alias("df_t"))
