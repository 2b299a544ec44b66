"""Grouping aggregates over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsq.functions.windows import quantile_of
from tsq.model import INF, NAME, NAN, drop_labels, format_column, keep_labels, key_of, nan_max, set_label

SIMPLE = {
    "sum": lambda: F.sum("v"),
    "min": lambda: F.min("v"),
    "max": lambda: nan_max("v"),
    "avg": lambda: F.avg("v"),
    "count": lambda: F.count(F.lit(1)).cast("double"),
    "group": lambda: F.max(F.lit(1.0)),
    "stddev": lambda: F.stddev_pop("v"),
    "stdvar": lambda: F.var_pop("v"),
}


def group_labels(grouping: tuple[str, ...], without: bool) -> Column:
    return drop_labels([*grouping, NAME]) if without else keep_labels(grouping)


def _by_value(op: str) -> list[Column]:
    return [F.isnan("v"), F.col("v").desc() if op == "topk" else F.col("v").asc()]


def series_hash() -> Column:
    """The digest of a series that ``limitk`` and ``limit_ratio`` choose by: of its labels in order, with a byte 1 between a
    name and its value and a byte 2 behind each value."""
    pairs = F.transform(key_of(), lambda e: F.concat(e["key"], F.lit("\x01"), e["value"], F.lit("\x02")))
    return F.md5(F.array_join(pairs, "").cast("binary"))


def aggregate_by_parameter(df: DataFrame, op: str, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """``topk``, ``bottomk`` or ``quantile`` with a parameter of its own at every step, in the column ``_p``."""
    group = group_labels(grouping, without)
    if op == "quantile":
        every = df.select(group.alias("labels"), "t", "v", "_p").groupBy("labels", "t").agg(F.array_sort(F.collect_list("v")).alias("x"), F.first("_p").alias("p"))
        at = F.when(F.col("p").between(0, 1), F.col("p") * (F.size("x") - 1)).otherwise(F.lit(0.0))
        low, high = (F.get("x", f(at).cast("int")) for f in (F.floor, F.ceil))
        inside = low + (high - low) * (at - F.floor(at))
        out = F.when(F.isnan("p"), F.lit(NAN)).when(F.col("p") < 0, F.lit(-INF)).when(F.col("p") > 1, F.lit(INF)).otherwise(inside)
        return every.select("labels", "t", out.alias("v"))
    rank = F.row_number().over(Window.partitionBy("_g", "t").orderBy(*_by_value(op), key_of()))
    rows = df.withColumn("_g", key_of(group)).withColumn("_k", rank)
    return rows.where(~F.isnan("_p") & (F.col("_k") <= F.floor(F.least("_p", F.lit(2.0**31))))).select("labels", "t", "v")


def aggregate(df: DataFrame, op: str, param, grouping: tuple[str, ...], without: bool) -> DataFrame:
    """``df`` is ``(labels, t, v)``; so is the result. Labels are projected before the shuffle."""
    group = group_labels(grouping, without)
    if op in SIMPLE or op == "quantile":
        agg = SIMPLE[op]() if op in SIMPLE else quantile_of(param)
        return df.select(group.alias("labels"), "t", "v").groupBy("labels", "t").agg(agg.alias("v"))
    if op == "count_values":
        labels = set_label(group, param, format_column(F.col("v")))
        return df.select(labels.alias("labels"), "t").groupBy("labels", "t").agg(F.count(F.lit(1)).cast("double").alias("v"))
    rows = df.withColumn("_g", key_of(group))
    if op in ("topk", "bottomk", "limitk"):
        if param != param or param < 1:
            return df.where(F.lit(False))
        order = [series_hash()] if op == "limitk" else _by_value(op)
        rank = F.row_number().over(Window.partitionBy("_g", "t").orderBy(*order, key_of()))
        return rows.withColumn("_k", rank).where(F.col("_k") <= int(min(param, 2**31 - 1))).select("labels", "t", "v")
    if op == "limit_ratio":
        share = F.conv(F.substring(series_hash(), 1, 8), 16, 10).cast("long") / float(1 << 32)
        return df.where(share < param if param >= 0 else share >= 1 + param)
    raise ValueError(op)
