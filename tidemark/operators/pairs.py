"""Operators on pairs of series: align, fit, spread, half-life, bands, episodes, signals.

A pair table has y, x, ts, ly, lx; pairs are found by an equi-join on ts with symbol order, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles as Q

KEY = ("y", "x")


def in_time():
    return Window.partitionBy(*KEY).orderBy("ts")


def align(bars: DataFrame, groups: DataFrame | None = None, least: int = 30, wanted: DataFrame | None = None) -> DataFrame:
    """All unordered pairs (y < x) on common times with log closes; pairs of one group and short pairs are left out."""
    side = bars.where("close > 0").select("symbol", "ts", F.ln("close").alias("l"))
    if groups is not None:
        side = side.join(groups, "symbol", "left").withColumn("g", F.coalesce("group_id", F.concat(F.lit("asset:"), "symbol"))).drop("group_id")
    else:
        side = side.withColumn("g", F.col("symbol"))
    if wanted is None:
        a, b = side.alias("a"), side.alias("b")
        both = a.join(b, (F.col("a.ts") == F.col("b.ts")) & (F.col("a.symbol") < F.col("b.symbol")) & (F.col("a.g") != F.col("b.g")))
        out = both.select(F.col("a.symbol").alias("y"), F.col("b.symbol").alias("x"), F.col("a.ts").alias("ts"), F.col("a.l").alias("ly"), F.col("b.l").alias("lx"))
    else:
        # the wanted pairs first, so that only they are built
        first = wanted.select("y", "x").where("y < x").distinct().join(side.select(F.col("symbol").alias("y"), "ts", F.col("l").alias("ly"), F.col("g").alias("gy")), "y")
        both = first.join(side.select(F.col("symbol").alias("x"), "ts", F.col("l").alias("lx"), F.col("g").alias("gx")), ["x", "ts"])
        out = both.where("gy <> gx").select("y", "x", "ts", "ly", "lx")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_n") >= least).drop("_n")


def spreads(pairs: DataFrame) -> DataFrame:
    """Adds alpha, beta and spread, the residual of ly on lx; a constant lx has no fit and goes."""
    w = Window.partitionBy(*KEY)
    out = pairs.withColumns({"beta": F.regr_slope("ly", "lx").over(w), "alpha": F.regr_intercept("ly", "lx").over(w)}).where("beta IS NOT NULL")
    return out.withColumn("spread", F.col("ly") - (F.col("alpha") + F.col("beta") * F.col("lx")))


def fit_stats(fitted: DataFrame, longest: int | None = None) -> DataFrame:
    """One row a pair: n, beta, half-life, bands, z-score, percentile and near-duplicate flag.

    Half-life: rho without intercept on the demeaned spread; null unless n >= 10 and 0 < rho < 1. longest: the rows of
    the longest pair where known; beyond Q.HELD the bands come from counts.
    """
    w = Window.partitionBy(*KEY)
    d = fitted.withColumns({"mean": F.avg("spread").over(w), "last": F.max_by("spread", "ts").over(w), "gap": (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(in_time())) / 3.6e9, "before": F.lag("spread").over(in_time())})
    z1, z2 = F.col("before") - F.col("mean"), F.col("spread") - F.col("mean")
    flat = F.abs(z1 - z2) <= 1e-8 + 1e-5 * F.abs(z2)
    s = F.col("spread")
    qs = (0.1, 0.3, 0.5, 0.7, 0.9)
    counted = longest is not None and longest > Q.HELD
    p = F.first(F.lit(None).cast("array<double>")) if counted else F.percentile("spread", F.array(*(F.lit(q) for q in qs)))
    out = d.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.first("last").alias("latest"),
        F.sum(z1 * z2).alias("z12"), F.sum(z1 * z1).alias("z11"), F.bool_and(flat).alias("flat"), F.median("gap").alias("gap_hours"),
        F.avg("spread").alias("mean"), F.stddev_samp("spread").alias("sd"), p.alias("p"),
        F.count_if(s < F.col("last")).alias("below"), F.count_if(s <= F.col("last")).alias("upto"),
        F.stddev_pop("ly").alias("sy"), F.stddev_pop("lx").alias("sx"), F.covar_pop("ly", "lx").alias("cov"),
    )
    if counted:
        out = out.drop("p").join(Q.exact(fitted, KEY, "spread", qs), list(KEY))
    rho = F.try_divide("z12", "z11")
    half = F.when((F.col("n") >= 10) & ~F.col("flat") & (rho > 0) & (rho < 1), -F.lit(0.6931471805599453) / F.ln(rho))
    r = F.try_divide(F.col("cov"), F.col("sy") * F.col("sx"))
    near = (F.abs(F.col("beta") - 1) < 0.04) & (F.col("n") >= 10) & ((F.col("sy") < 1e-12) | (F.col("sx") < 1e-12) | F.coalesce(r >= 0.997, F.lit(False)))
    z = F.when((F.col("n") >= 20) & (F.col("sd") >= 1e-12), (F.col("latest") - F.col("mean")) / F.col("sd"))
    return out.select(
        *KEY, "n", "alpha", "beta", "latest", half.alias("half_life_bars"), F.when(F.col("gap_hours") > 0, half * F.col("gap_hours")).alias("half_life_hours"),
        z.alias("z"), signal(z, F.col("n"), F.col("sd")).alias("signal"), *(F.col("p")[k].alias(f"p{q}") for k, q in enumerate((10, 30, 50, 70, 90))),
        ((F.col("below") + F.col("upto") + (F.col("upto") > F.col("below")).cast("int")) * 50.0 / F.col("n")).alias("percentile"), near.alias("near_duplicate"),
    )


def signal(z: Column, n: Column, sd: Column) -> Column:
    return F.when(n < 20, "Insufficient history for Z-score").when(sd < 1e-12, "Spread std ~ 0").when(z > 2, "Short Y / Long X").when(z < -2, "Long Y / Short X").otherwise("Neutral")


def episodes(fitted: DataFrame, least: int = 20, span_days: int = 365, longest: int | None = None) -> DataFrame:
    """y, x, kind, start, stop, hours of completed excursions of the spread.

    High: entered when the spread comes to p90 from below (or begins there), left at the first later value at or under
    p70. Low mirrors it with p10 and p30.

    Each row is a function of the state (inside or not): it enters, leaves, does nothing or, where both bands are equal,
    turns the state over. Functions compose, so the rows of a pair are cut into spans of time: each span is composed by
    itself, spans are composed along the pair, and with its incoming state each span finds its own starts and stops.
    Only those, and one row a span, meet in a pair's own task.
    """
    qs = (0.1, 0.3, 0.7, 0.9)
    d = fitted.select(*KEY, "ts", "spread").withColumn("_at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (span_days * 86_400_000_000)))
    bands = quantiles(d, qs, longest).where(F.col("n") >= least)
    d = d.join(bands, list(KEY)).repartition(*KEY, "_at")
    # negative values for the low side, so that both sides read alike
    side = lambda kind, sign, outer, inner: F.struct(F.lit(kind).alias("kind"), (F.col("spread") * sign).alias("v"), (F.col("p")[outer] * sign).alias("outer"), (F.col("p")[inner] * sign).alias("inner"))
    d = d.select(*KEY, "_at", "ts", F.inline(F.array(side("high", 1, 3, 2), side("low", -1, 0, 1))))
    span, pair = [*KEY, "kind", "_at"], Window.partitionBy(*KEY, "kind").orderBy("_at")
    along = Window.partitionBy(*span).orderBy("ts")
    d = d.withColumn("prev", F.lag("v").over(along))
    inside = F.col("prev").isNotNull()

    def functions(enter: Column, leave: Column) -> tuple[Column, Column]:
        """(turns: 1 if the state is turned over, to: the state if it is set, else null)"""
        return (enter & leave).cast("int"), F.when(enter & ~leave, 1).when(leave & ~enter, 0)

    turns, to = functions((F.col("v") >= F.col("outer")) & (F.col("prev") < F.col("outer")), F.col("v") <= F.col("inner"))
    d = d.withColumns({"turns": F.when(inside, turns).otherwise(0), "to": F.when(inside, to)})
    d = d.withColumn("turned", F.sum("turns").over(along))
    # what a span sets the state to, with the turns up to there taken out again
    base = F.when(F.col("to").isNotNull(), (F.col("to") + F.col("turned")) % 2)
    spans = d.groupBy(*span).agg(F.max_by(base, F.when(base.isNotNull(), F.col("ts"))).alias("base"), F.sum("turns").alias("turned"), F.min_by("v", "ts").alias("first"), F.max_by("v", "ts").alias("last"), F.first("outer").alias("outer"), F.first("inner").alias("inner"))
    spans = spans.withColumn("prior", F.lag("last").over(pair))
    turns, to = functions((F.col("first") >= F.col("outer")) & (F.col("prior").isNull() | (F.col("prior") < F.col("outer"))), F.col("first") <= F.col("inner"))
    # the first row, which looks at the span before, and then the rest
    out = F.when(F.col("base").isNotNull(), F.col("base") + F.col("turned")).when(to.isNotNull(), to + F.col("turned")) % 2
    spans = spans.withColumns({"sets": out, "flips": F.when(out.isNull(), F.col("turned") + turns).otherwise(0)}).withColumn("flipped", F.sum("flips").over(pair))
    state = (F.coalesce(F.last(F.when(F.col("sets").isNotNull(), (F.col("sets") + F.col("flipped")) % 2), ignorenulls=True).over(pair), F.lit(0)) + F.col("flipped")) % 2
    known = spans.withColumn("after", state).select(*span, "prior", F.coalesce(F.lag("after").over(pair), F.lit(0)).alias("incoming"))
    d = d.select(*span, "ts", "v", "outer", "inner", "prev").join(known, span)
    before = F.coalesce("prev", "prior")
    enter, leave = (F.col("v") >= F.col("outer")) & (before.isNull() | (before < F.col("outer"))), F.col("v") <= F.col("inner")
    turns, to = functions(enter, leave)
    d = d.withColumns({"enter": enter, "leave": leave, "turned": F.sum(turns).over(along), "to": to})
    base = F.when(F.col("to").isNotNull(), (F.col("to") + F.col("turned")) % 2)
    d = d.withColumn("after", (F.coalesce(F.last(base, ignorenulls=True).over(along), F.col("incoming")) + F.col("turned")) % 2)
    d = d.withColumn("was", F.coalesce(F.lag("after").over(along), F.col("incoming")))
    events = d.where("(was = 0 AND enter) OR (was = 1 AND leave)").select(*KEY, "kind", F.col("ts").cast("timestamp").alias("stop"), "was")
    events = events.withColumn("start", F.lag("stop").over(Window.partitionBy(*KEY, "kind").orderBy("stop"))).where("was = 1")
    return events.select(*KEY, "kind", "start", "stop", ((F.unix_micros("stop") - F.unix_micros("start")) / 3.6e9).alias("hours"))


def quantiles(fitted: DataFrame, qs: tuple[float, ...], longest: int | None = None) -> DataFrame:
    """y, x, n, p of the spread. longest: the rows of the longest pair, counted if not given; beyond Q.HELD the values
    are not held but counted."""
    if longest is None:
        longest = fitted.groupBy(*KEY).count().agg(F.max("count")).head()[0] or 0  # one number
    if longest <= Q.HELD:
        return fitted.groupBy(*KEY).agg(F.count("*").alias("n"), F.percentile("spread", F.array(*(F.lit(q) for q in qs))).alias("p"))
    return fitted.groupBy(*KEY).agg(F.count("*").alias("n")).join(Q.exact(fitted, KEY, "spread", qs), list(KEY))


def episode_summary(found: DataFrame) -> DataFrame:
    high, low = F.col("kind") == "high", F.col("kind") == "low"
    return found.groupBy(*KEY).agg(
        F.count_if(high).alias("n_high"), F.avg(F.when(high, F.col("hours"))).alias("high_hours"), F.count_if(low).alias("n_low"), F.avg(F.when(low, F.col("hours"))).alias("low_hours")
    )


def returns(pairs: DataFrame, bars: int = 150) -> DataFrame:
    """Simple returns ry, rx of the last `bars` common rows; the first row has none and goes."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("ts"))
    d = pairs.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= bars)
    one = lambda c: F.exp(F.col(c) - F.lag(c).over(in_time())) - 1
    return d.withColumns({"ry": one("ly"), "rx": one("lx")}).where("ry IS NOT NULL AND rx IS NOT NULL").drop("_k")


def rebased(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"ry": F.col("ly") - F.first("ly").over(in_time()), "rx": F.col("lx") - F.first("lx").over(in_time())})


def chart_window(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: bars, whole days, first and last day, fit, half-life and percentile."""
    span = pairs.groupBy(*KEY).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    days = F.floor((F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 86_400_000_000)
    return stats.join(span, list(KEY)).select(F.concat_ws("|", "y", "x").alias("pair"), "n", days.alias("days"), F.date_format("t0", "yyyy-MM-dd").alias("t_start"), F.date_format("t1", "yyyy-MM-dd").alias("t_end"), "alpha", "beta", "half_life_hours", "percentile")


def weekend_bands(spans: DataFrame, most: int = 160) -> DataFrame:
    """key, band_start, band_end of two-day bands from the first Saturday on, every k weeks; at most `most` a key."""
    first = F.date_add("start_day", F.pmod(F.lit(7) - F.dayofweek("start_day"), F.lit(7)))
    d = spans.where("end_day > start_day").withColumn("first", first).where("first <= date_add(end_day, 1)")
    weeks = F.floor(F.datediff(F.date_add("end_day", 1), "first") / 7) + 1
    k = F.ceil(weeks / most).cast("int")
    at = F.explode(F.transform(F.sequence(F.lit(0), (F.floor((weeks - 1) / k)).cast("int")), lambda i: F.date_add(F.col("first"), (i * k * 7).cast("int"))))
    return d.select("key", at.alias("band_start")).withColumn("band_end", F.date_add("band_start", 2))


def key_of(y: Column, x: Column) -> Column:
    return F.concat_ws("|", y, x)


def find(pairs: DataFrame, key: str) -> DataFrame:
    """The row of the pair named by its key `y|x`; none if it is not there."""
    y, _, x = key.partition("|")
    return pairs.where((F.col("y") == y) & (F.col("x") == x)).limit(1)
