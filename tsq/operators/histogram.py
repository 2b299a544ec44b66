"""Quantiles of classic histograms; statistics, aggregates and windows of native histogram structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.functions.windows import stretched
from tsq.model import INF, NAME, NAN, drop_labels, label
from tsq.operators.aggregate import group_labels

#: Native histogram column, here with its buckets expanded to (lower, upper, count).
HISTOGRAM = "struct<count double, sum double, buckets array<struct<lower double, upper double, n double>>>"


def histogram_quantile(phi: float, df: DataFrame) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank; buckets are the cumulative counts by ``le``."""
    bound = F.when(F.lower(label("le")).isin("+inf", "inf"), F.lit(INF)).otherwise(F.expr("try_cast(try_element_at(labels, 'le') AS double)"))
    rows = df.select(drop_labels(["le", NAME]).alias("labels"), "t", bound.alias("le"), "v").where(F.col("le").isNotNull())
    rows = rows.groupBy("labels", "t", "le").agg(F.sum("v").alias("v"))
    b = rows.groupBy("labels", "t").agg(F.array_sort(F.collect_list(F.struct("le", "v"))).alias("b"))
    # cumulative counts never fall
    rising = F.aggregate("b", F.expr("CAST(array() AS array<struct<le:double,v:double>>)"), lambda a, x: F.concat(a, F.array(F.struct(x["le"].alias("le"), F.greatest(x["v"], F.coalesce(F.try_element_at(a, F.lit(-1))["v"], x["v"])).alias("v")))))
    b = b.withColumn("b", rising).withColumn("n", F.size("b")).withColumn("total", F.element_at("b", -1)["v"]).withColumn("top", F.element_at("b", -1)["le"])
    if phi != phi or phi < 0 or phi > 1:
        out = F.lit(NAN if phi != phi else -INF if phi < 0 else INF)
    else:
        rank = F.col("total") * phi
        at = F.size(F.filter("b", lambda x: x["v"] < rank))
        b = b.withColumn("rank", rank).withColumn("at", at)
        hi = F.get("b", F.col("at"))
        before = F.get("b", F.col("at") - 1)
        low = F.when(F.col("at") == 0, F.lit(0.0)).otherwise(before["le"])
        under = F.when(F.col("at") == 0, F.lit(0.0)).otherwise(before["v"])
        inside = low + (hi["le"] - low) * ((F.col("rank") - under) / F.when(hi["v"] - under > 0, hi["v"] - under).otherwise(F.lit(1.0)))
        out = (
            F.when(F.col("at") >= F.col("n") - 1, F.get("b", F.col("n") - 2)["le"])
            .when((F.col("at") == 0) & (hi["le"] <= 0), hi["le"])
            .otherwise(inside)
        )
    value = F.when((F.col("top") != INF) | (F.col("n") < 2) | (F.col("total") == 0) | F.isnan("total"), F.lit(NAN)).otherwise(out)
    return b.select("labels", "t", value.alias("v"))


def histogram_stats(h: str) -> dict[str, Column]:
    """count, sum, avg, stdvar and stddev of a native histogram column; buckets count at their middles."""
    c = F.col(h)
    mean = F.when(c["count"] != 0, c["sum"] / F.when(c["count"] != 0, c["count"]).otherwise(F.lit(1.0))).otherwise(F.lit(NAN))
    mid = lambda b: F.when((b["lower"] > 0), F.sqrt(b["lower"] * b["upper"])).when(b["upper"] < 0, -F.sqrt(b["lower"] * b["upper"])).otherwise((b["lower"] + b["upper"]) / 2)
    var = F.aggregate(c["buckets"], F.lit(0.0), lambda a, b: a + b["n"] * (mid(b) - mean) * (mid(b) - mean)) / F.when(c["count"] != 0, c["count"])
    var = F.coalesce(var, F.lit(NAN))
    return {"count": c["count"], "sum": c["sum"], "avg": mean, "stdvar": var, "stddev": F.sqrt(var)}


def histogram_fraction(lower: float, upper: float, h: str) -> Column:
    """Share of observations between two values, linear inside buckets."""
    c = F.col(h)

    def below(x: float) -> Column:
        part = lambda b: F.when(b["upper"] <= x, 1.0).when(b["lower"] >= x, 0.0).otherwise((F.lit(x) - b["lower"]) / (b["upper"] - b["lower"]))
        return F.aggregate(c["buckets"], F.lit(0.0), lambda a, b: a + b["n"] * part(b))

    return F.when(c["count"] == 0, F.lit(NAN)).otherwise((below(upper) - below(lower)) / F.when(c["count"] != 0, c["count"]).otherwise(F.lit(1.0)))


def native_quantile(phi: float, h: str) -> Column:
    """The quantile of a native histogram: linear inside a bucket, or by the logarithm where both its edges are positive."""
    c = F.col(h)
    if phi != phi or phi < 0 or phi > 1:
        return F.lit(NAN if phi != phi else -INF if phi < 0 else INF)
    buckets = F.array_sort(F.filter(c["buckets"], lambda b: b["n"] > 0))
    zero = F.struct(F.lit(0.0).alias("under"), F.lit(None).cast("double").alias("x"))
    rank = c["count"] * phi

    def step(a, b):
        part = (rank - a["under"]) / b["n"]
        ratio = F.when(b["lower"] > 0, b["upper"] / F.when(b["lower"] > 0, b["lower"]))
        inside = F.when(b["lower"] > 0, b["lower"] * F.pow(ratio, part)).otherwise(b["lower"] + (b["upper"] - b["lower"]) * part)
        found = F.when(a["x"].isNull() & (a["under"] + b["n"] >= rank), inside).otherwise(a["x"])
        return F.struct((a["under"] + b["n"]).alias("under"), found.alias("x"))

    found = F.aggregate(buckets, zero, step, lambda a: a["x"])
    return F.when(c["count"] > 0, F.coalesce(found, F.element_at(buckets, -1)["upper"])).otherwise(F.lit(NAN))


#: Calls over native histograms in a column ``h``; their numbers come first.
HISTOGRAM_CALLS = {
    "histogram_count": lambda: histogram_stats("h")["count"],
    "histogram_sum": lambda: histogram_stats("h")["sum"],
    "histogram_avg": lambda: histogram_stats("h")["avg"],
    "histogram_stddev": lambda: histogram_stats("h")["stddev"],
    "histogram_stdvar": lambda: histogram_stats("h")["stdvar"],
    "histogram_fraction": lambda lower, upper: histogram_fraction(lower, upper, "h"),
    "histogram_quantile": lambda phi: native_quantile(phi, "h"),
}


def _assembled(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, h)`` from rows ``(keys, kind, lower, upper, n)`` that are unique by keys and part; kind is count, sum or bucket."""
    bucket = F.when(F.col("kind") == "bucket", F.struct("lower", "upper", "n"))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    h = F.struct(one("count").alias("count"), one("sum").alias("sum"), F.array_sort(F.collect_list(bucket)).alias("buckets"))
    return parts.groupBy(*keys).agg(h.alias("h"))


def aggregate_histograms(df: DataFrame, op: str, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """Sum or mean of the histograms ``(labels, t, h)`` of a group, bucket by bucket, partial ahead of the shuffle."""
    own = df.select(group_labels(grouping, without).alias("labels"), "t", F.explode(_parts_of(F.col("h"))).alias("p"))
    one = F.when(F.col("p.kind") == "count", 1).otherwise(0)
    parts = own.groupBy("labels", "t", "p.kind", "p.lower", "p.upper").agg(F.sum("p.n").alias("n"), F.sum(one).alias("of"))
    if op == "avg":
        members = parts.where("kind = 'count'").select(F.map_entries("labels").alias("_k"), "t", "of")
        parts = parts.drop("of").withColumn("_k", F.map_entries("labels")).join(members, ["_k", "t"]).withColumn("n", F.col("n") / F.col("of"))
    return _assembled(parts.select("labels", "t", "kind", "lower", "upper", "n"), ["labels", "t"])


def histogram_windows(name: str, rows: DataFrame, range_ms: int) -> DataFrame:
    """``(labels, t, h)`` of rate, increase or delta over rows ``(key, ts, h, t, lo)``, each at every step that holds it.

    Every part is a series of its own with 0 where a sample lacks the bucket. A counter's histogram has started anew when any
    part of it fell; all its parts then add what they had before.
    """
    counter = name != "delta"
    window = Window.partitionBy("key", "t").orderBy("ts")
    bounds = rows.select("key", "t", F.explode("h.buckets").alias("b")).groupBy("key", "t").agg(F.collect_set(F.struct("b.lower", "b.upper")).alias("bounds"))
    rows = rows.join(bounds, ["key", "t"], "left").withColumn("bounds", F.coalesce("bounds", F.array().cast("array<struct<lower:double,upper:double>>")))
    count = lambda b: F.coalesce(F.get(F.filter(F.col("h.buckets"), lambda x: (x["lower"] == b["lower"]) & (x["upper"] == b["upper"])), F.lit(0))["n"], F.lit(0.0))
    whole = F.struct(F.col("h.count").alias("count"), F.col("h.sum").alias("sum"), F.transform("bounds", lambda b: F.struct(b["lower"].alias("lower"), b["upper"].alias("upper"), count(b).alias("n"))).alias("buckets"))
    rows = rows.withColumn("a", _parts_of(whole)).withColumn("p", F.coalesce(F.lag("a").over(window), "a"))
    fell = F.exists(F.arrays_zip("a", "p"), lambda z: (z["a"]["kind"] != "sum") & (z["a"]["n"] < z["p"]["n"]))
    rows = rows.withColumn("fell", F.coalesce(fell, F.lit(False)) if counter else F.lit(False))
    each = rows.select("key", "t", "lo", "ts", "fell", F.explode(F.arrays_zip("a", "p")).alias("z"))
    each = each.select("key", "t", "lo", "ts", "fell", "z.a.kind", "z.a.lower", "z.a.upper", F.col("z.a.n").alias("v"), F.col("z.p.n").alias("pv"))
    grouped = each.groupBy("key", "t", "kind", "lower", "upper").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("v", "ts").alias("v0"), F.max_by("v", "ts").alias("v1"),
        F.sum(F.when(F.col("fell"), F.col("pv")).otherwise(0.0)).alias("fall"), F.first("lo").alias("lo"),
    ).where("n >= 2")
    value = stretched(F.col("v1") - F.col("v0") + F.col("fall"), range_ms, name == "rate", zero=False)
    parts = grouped.select("key", "t", "kind", "lower", "upper", value.alias("n"))
    return _assembled(parts, ["key", "t"]).select(F.map_from_entries("key").alias("labels"), "t", "h")


def _parts_of(h: Column) -> Column:
    """A histogram as an array of (kind, lower, upper, n)."""
    zero = F.lit(0.0)
    part = lambda kind, lower, upper, n: F.struct(F.lit(kind).alias("kind"), lower.alias("lower"), upper.alias("upper"), n.alias("n"))
    ends = F.array(part("count", zero, zero, h["count"]), part("sum", zero, zero, h["sum"]))
    return F.concat(ends, F.transform(h["buckets"], lambda b: part("bucket", b["lower"], b["upper"], b["n"])))
