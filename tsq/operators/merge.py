"""Merging replicas of one series: window expressions over slices of series.

The side with more samples is the base (ties: the first) and keeps every sample. A sample of the other side is added
where it is farther than the buffer from the base samples around it; between two base samples these must also lie more
than twice the buffer apart. The rule is local, so a series is cut into slices of time: one aggregation by (series, slice)
tells each slice its base side and the nearest base samples outside it, and all else happens inside a slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.model import key_of

MIN_GAPS = 3
SLICE_MS = 86_400_000


def _slices(rows: DataFrame) -> DataFrame:
    """By (series, slice): whether side 1 is the base, the base's last time before and first time after the slice, each
    side's last time before, the series' first base time, and whether the other side starts ahead of it."""
    on = lambda side: F.when(F.col("_side") == side, F.col("t"))
    per = rows.groupBy("_key", "_slice").agg(
        F.count(on(0)).alias("n0"), F.count(on(1)).alias("n1"), F.min(on(0)).alias("lo0"), F.max(on(0)).alias("hi0"), F.min(on(1)).alias("lo1"), F.max(on(1)).alias("hi1")
    )
    series = Window.partitionBy("_key")
    before = series.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    after = series.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_one", F.sum("n1").over(series) > F.sum("n0").over(series))
    base = lambda name, own=True: F.when(F.col("_one") == own, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    return per.select(
        "_key",
        "_slice",
        "_one",
        F.max(base("hi")).over(before).alias("_left"),
        F.min(base("lo")).over(after).alias("_right"),
        F.max("hi0").over(before).alias("_last0"),
        F.max("hi1").over(before).alias("_last1"),
        F.min(base("lo")).over(series).alias("_first"),
        (F.min(base("lo", False)).over(series) < F.min(base("lo")).over(series)).alias("_led"),
    )


def _dynamic(rows: DataFrame) -> DataFrame:
    """``(_key, _dyn)``: half the upper median of the longer side's positive gaps, with the other side's gaps where it has
    under three; null where both have too few. Equal gaps are counted ahead of the shuffle."""
    own = F.lag("t").over(Window.partitionBy("_key", "_slice", "_side").orderBy("t"))
    gap = F.col("t") - F.coalesce(own, F.when(F.col("_side") == 1, F.col("_last1")).otherwise(F.col("_last0")))
    counts = rows.select("_key", gap.alias("gap"), F.when(F.col("_base"), 1).otherwise(0).alias("x")).where("gap > 0")
    counts = counts.groupBy("_key", "gap").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("every"))
    series = Window.partitionBy("_key")
    used = F.when(F.sum("x").over(series) < MIN_GAPS, F.col("every")).otherwise(F.col("x"))
    counts = counts.withColumn("n", used)
    counts = counts.withColumn("upto", F.sum("n").over(series.orderBy("gap"))).withColumn("all", F.sum("n").over(series))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("gap")))
    return counts.where(F.col("all") >= MIN_GAPS).groupBy("_key").agg(F.floor(middle / 2).cast("long").alias("_dyn"))


def merge_pair(a: DataFrame, b: DataFrame, buffer_ms: int = 10_000, dynamic: bool = False, prefer_max: bool = False, value: str = "v", slice_ms: int = SLICE_MS) -> DataFrame:
    """``(labels, t, value)`` of two sides, merged by series; histograms merge as floats do. With ``prefer_max`` a base sample
    takes the value of the first other sample inside the buffer (or at its own time) if that is larger, but not the first
    base sample when nothing of the other side precedes it."""
    if dynamic and prefer_max:
        raise ValueError("prefer_max takes a static buffer")
    rows = a.select("labels", "t", value, F.lit(0).alias("_side")).unionByName(b.select("labels", "t", value, F.lit(1).alias("_side")))
    rows = rows.select(key_of().alias("_key"), "t", value, "_side", F.floor(F.col("t") / slice_ms).alias("_slice"))
    slices = _slices(rows)
    known = rows.join(slices, ["_key", "_slice"]).withColumn("_base", (F.col("_side") == 1) == F.col("_one"))
    buffer: Column = F.lit(buffer_ms).cast("long")
    if dynamic:
        slices = slices.join(_dynamic(known), "_key", "left")
        known = rows.join(slices, ["_key", "_slice"]).withColumn("_base", (F.col("_side") == 1) == F.col("_one"))
        buffer = F.coalesce("_dyn", buffer)
    known = known.withColumn("_at", F.col("_slice"))
    reach = max(0, buffer_ms - 1)
    if prefer_max:
        # samples of the other side also stand in the slices that they can reach
        spread = F.sequence(F.floor((F.col("t") - reach) / slice_ms), F.floor((F.col("t") + reach) / slice_ms))
        known = known.withColumn("_at", F.explode(F.when(F.col("_base"), F.array("_slice")).otherwise(spread)))
    own = F.when(F.col("_base"), F.col("t"))
    part = Window.partitionBy("_key", "_at")
    by_time = part.orderBy("t")
    known = known.withColumn("_x", F.coalesce(F.max(own).over(by_time.rangeBetween(Window.unboundedPreceding, 0)), F.col("_left")))
    known = known.withColumn("_y", F.coalesce(F.min(own).over(part.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)), F.col("_right")))
    t, x, y = F.col("t"), F.col("_x"), F.col("_y")
    free = F.when(x.isNull(), t < y - buffer).when(y.isNull(), t > x + buffer).otherwise((y - x > buffer * 2) & (t > x + buffer) & (t < y - buffer))
    out = F.col(value)
    if prefer_max:
        known = known.withColumn("_near", F.min(F.when(~F.col("_base"), F.struct("t", value))).over(by_time.rangeBetween(-reach, reach)))
        may = (t != F.col("_first")) | F.coalesce("_led", F.lit(True))
        out = F.when(F.col("_base") & may & (F.col(f"_near.{value}") > out), F.col(f"_near.{value}")).otherwise(out)
    kept = known.where((F.col("_at") == F.col("_slice")) & (F.col("_base") | F.coalesce(free, F.lit(False))))
    return kept.select(F.map_from_entries("_key").alias("labels"), "t", out.alias(value))


def merge_replicas(sides: list[DataFrame], buffer_ms: int = 10_000, **how) -> DataFrame:
    """All replicas folded from left to right; one alone is returned as it is."""
    return reduce(lambda a, b: merge_pair(a, b, buffer_ms, **how), sides)


def union_shards(shards: list[DataFrame], value: str = "v") -> DataFrame:
    """``(labels, t, value)`` of shards, each sample in one of them: all stay, those of one label set and time too."""
    return reduce(DataFrame.unionByName, [d.select("labels", "t", value) for d in shards])


def merge_vectors(sides: list[DataFrame], prefer_max: bool = False) -> DataFrame:
    """Instant vectors by label set and time: the first value that is not 0, or the largest."""
    rows = reduce(DataFrame.unionByName, [d.select("labels", "t", "v", F.lit(k).alias("_k")) for k, d in enumerate(sides)])
    pick = F.max("v") if prefer_max else F.coalesce(F.min_by(F.when(F.col("v") != 0, F.col("v")), F.when(F.col("v") != 0, F.col("_k"))), F.min_by("v", "_k"))
    return rows.groupBy("labels", "t").agg(pick.alias("v"))
