"""Exact quantiles of long groups by counting over value ranges, without holding a group's values.

A wanted rank lies in a range of values. The range is cut into BINS equal parts, the values in each are counted (with
their least and largest, map-side first), and the rank moves into one part, whose least and largest value are the next
range. It ends where the range holds one value, or no more than `held` values, which are then sorted. The state of a
round is BINS counts a wanted rank, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

#: Values of a group that may be held at once; parts of a range.
HELD, BINS = 1 << 16, 1024


def exact(rows: DataFrame, key: Sequence[str], value: str, qs: Sequence[float], held: int = HELD) -> DataFrame:
    """key, p: the quantiles qs of each group's values, interpolated between neighbours as `percentile` does. Nulls do
    not count; a group without values has no row."""
    v = F.col("_v")
    rows = rows.select(*key, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ends = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.array(*(F.lit(float(q)) for q in qs))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda q: F.array(F.floor(q * (F.col("_n") - 1)), F.ceil(q * (F.col("_n") - 1))))))
    sizes = files.kept(ends, "ends")
    targets = files.kept(sizes.select(*key, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count")), "targets")
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_count") > held)
    span = [*key, "_lo", "_hi"]
    while targets.where(wide).limit(1).count():
        open_ = targets.where(wide).select(*span, "_below").distinct()
        width = F.col("_hi") - F.col("_lo")  # never 0; where it overflows, halves do not
        part = F.when(width < float("inf"), (v - F.col("_lo")) / width).otherwise((v / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
        found = rows.join(open_, list(key)).where(v.between(F.col("_lo"), F.col("_hi"))).withColumn("_bin", F.least(F.floor(part * BINS), F.lit(BINS - 1)))
        bins = found.groupBy(*span, "_below", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*span).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("_start", F.col("_below") + before).drop("_below")
        moved = targets.where(wide).drop("_below", "_count").join(bins, span).where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_c")))
        moved = moved.select(*key, "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_start").alias("_below"), F.col("_c").alias("_count"))
        targets = files.kept(targets.where(~wide).unionByName(moved), "targets")
    many = targets.where("_lo < _hi").select(*span).distinct()
    values = rows.join(many, list(key)).where(v.between(F.col("_lo"), F.col("_hi"))).groupBy(*span).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    one = targets.join(values, span, "left").withColumn("_x", F.coalesce(F.get("_vs", (F.col("_rank") - F.col("_below")).cast("int")), F.col("_lo")))
    held_ = one.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def between(q):
        place = q * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    return sizes.join(held_, list(key)).select(*key, F.transform(at, between).alias("p"))
