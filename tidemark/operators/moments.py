"""Moments of lagged series in aggregates, and regressions from them in expressions.

One pass over a pair's rows sums the products of each series with the lags of each other, and keeps the first and last
`top` values. The moments of any regression on lags over the rows from `drop` on are those sums less a few products at
both ends, so that every lag order, with its own rows, comes from one state of fixed size. Cholesky factors of a moment
matrix solve all nested regressions at once: with the dependent variable last, its row c holds, for each m, the sum of
squares that remains after the first m variables: yy - c_1^2 - ... - c_m^2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The share of a variable's sum of squares below which the rest of it is rounding: it adds nothing to those before it.
ROUNDING = 1e-13


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def lag_moments(rows: DataFrame, key: Sequence[str], order: str, series: Sequence[str], top: int) -> DataFrame:
    """key, rows, sums, head, tail: sums[p][h] is the sum of a_t b_(t-h) for p = a * len(series) + b; head and tail hold
    the first and last `top` values of each series. Rows must have all series."""
    w = Window.partitionBy(*key).orderBy(order)
    lags = {f"_{c}{h}": F.lag(c, h).over(w) for c in series for h in range(1, top + 1)}
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = rows.select(*key, order, *series).withColumns({**lags, "_k": F.row_number().over(w), "_n": F.count("*").over(every)})
    values = F.struct("_k", *series)
    sums = [F.sum(F.col(a) * F.col(f"_{b}{h}" if h else b)).alias(f"_s{i}_{h}") for i, (a, b) in enumerate((a, b) for a in series for b in series) for h in range(top + 1)]
    ends = {"_head": F.col("_k") <= top, "_tail": F.col("_k") > F.col("_n") - top}
    agg = d.groupBy(*key).agg(F.count("*").alias("rows"), *sums, *(F.sort_array(F.collect_list(F.when(at, values))).alias(c) for c, at in ends.items()))
    cross = F.array(*(F.array(*(F.coalesce(f"_s{i}_{h}", F.lit(0.0)) for h in range(top + 1))) for i in range(len(series) ** 2)))
    pick = lambda c: F.array(*(F.col(c)[s] for s in series))
    return agg.select(*key, "rows", cross.alias("sums"), pick("_head").alias("head"), pick("_tail").alias("tail"))


def variables(*of: tuple[int | Column, int | Column]) -> Column:
    """array of struct(s, k): series number and lag."""
    return F.array(*(F.struct(*(v if isinstance(v, Column) else F.lit(v) for v in p)) for p in of)).cast("array<struct<s:int,k:int>>")


def lagged(series: int, count: Column | int) -> Column:
    """The lags 1 to count of a series."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.transform(upto(count), lambda k: F.struct(F.lit(series).alias("s"), (k + 1).alias("k"))).cast("array<struct<s:int,k:int>>")


def moment(u: Column, v: Column, drop: Column, series: int) -> Column:
    """The sum over rows t >= drop of the products of two variables, from columns sums, head, tail."""
    later, earlier = F.when(u["k"] <= v["k"], u).otherwise(v), F.when(u["k"] <= v["k"], v).otherwise(u)

    def of(x: Column) -> Column:
        i, j, a, b = x["a"]["k"], x["b"]["k"], x["a"]["s"], x["b"]["s"]
        cut, size = F.greatest(drop - j, F.lit(0)), F.size(F.get("tail", F.lit(0)))
        total = F.get(F.get("sums", a * series + b), j - i)
        first = dot(F.slice(F.get("head", a), j - i + 1, cut), F.slice(F.get("head", b), 1, cut))
        last = dot(F.slice(F.get("tail", a), size - i + 1, i), F.slice(F.get("tail", b), size - j + 1, i))
        return total - first - last

    return let(F.struct(later.alias("a"), earlier.alias("b")), of)


def matrix(vs: Column, drop: Column, series: int) -> Column:
    """The lower triangle of the variables' moments, row by row."""
    return let(vs, lambda x: F.transform(x, lambda u, i: F.transform(F.slice(x, 1, i + 1), lambda v: moment(u, v, drop, series))))


def factor(m: Column) -> Column:
    """The Cholesky factor, row by row; a variable that those before it explain has a 0 on the diagonal and in its column."""
    def row(done: Column, given: Column) -> Column:
        def entry(r: Column, j: Column) -> Column:
            at = F.get(done, j)
            pivot = F.get(at, j)
            rest = F.get(given, j) - dot(r, F.slice(at, 1, j))
            return F.array_append(r, F.when(pivot > 0, rest / pivot).otherwise(0.0))

        def closed(r: Column) -> Column:
            whole = F.get(given, F.size(r))
            left = whole - dot(r, r)
            return F.array_append(r, F.when(left > ROUNDING * whole, F.sqrt(left)).otherwise(0.0))

        return F.array_append(done, let(F.aggregate(upto(F.size(done)), F.array().cast("array<double>"), entry), closed))

    return F.aggregate(m, F.array().cast("array<array<double>>"), row)


def nested(c: Column, yy: Column) -> Column:
    """The sums of squares that remain after 0, 1, ... of the variables before the last one; c: the factor's last row."""
    first = F.array(yy)
    return F.aggregate(F.slice(c, 1, F.size(c) - 1), first, lambda out, v: F.array_append(out, F.element_at(out, -1) - v * v))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function: a series about 0, a continued fraction in the tails."""
    def of(v: Column) -> Column:
        density = F.exp(-v * v / 2) * 0.3989422804014327
        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(v.alias("term"), v.alias("sum")), lambda s, k: F.struct((s["term"] * v * v / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * v * v / (2 * k + 1)).alias("sum")))["sum"]
        tail = density / F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.abs(v), lambda x, k: F.abs(v) + k / x)
        return F.when(F.abs(v) < 3, 0.5 + density * series).when(v > 0, 1 - tail).otherwise(tail)

    return let(z.cast("double"), of)


def ln_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 10, stepped down."""
    def of(v: Column) -> Column:
        x = v + 10
        stirling = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
        return stirling - F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, k: s + F.ln(v + k))

    return let(z.cast("double"), of)


def beta_cdf(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function by its continued fraction (Lentz's rule), on the side where it settles fast."""
    def of(p: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
        sure = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

        def half(s: Column, t: Column) -> Column:
            def one(d: Column) -> Column:
                c = sure(1 + t / s["c"])
                return F.struct(c.alias("c"), d.alias("d"), (s["out"] * d * c).alias("out"))

            return let(1 / sure(1 + t * s["d"]), one)

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return let(half(s, even), lambda h: half(h, odd))

        begin = let(1 / sure(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("out")))
        steps = F.sequence(F.lit(1), (50 + 2 * F.sqrt(F.greatest(a, b))).cast("int"))
        return front / a * F.aggregate(steps, begin, step)["out"]

    one = lambda p, q, v: let(F.struct(p.alias("a"), q.alias("b"), v.alias("x")), of)
    both = lambda p: F.when(p["x"] <= 0, 0.0).when(p["x"] >= 1, 1.0).when(p["x"] < (p["a"] + 1) / (p["a"] + p["b"] + 2), one(p["a"], p["b"], p["x"])).otherwise(1 - one(p["b"], p["a"], 1 - p["x"]))
    return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x")), both)


def f_survival(f: Column, d1: Column, d2: Column) -> Column:
    """The tail of the F distribution."""
    return F.when(f <= 0, 1.0).otherwise(beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))
