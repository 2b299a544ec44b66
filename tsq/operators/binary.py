"""Vector matching: equi-joins on a subset of the labels and the step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.model import NAME, arithmetic, compare, drop_labels, drop_name, keep_labels, key_of
from tsq.promql.ast import Binary
from tsq.promql.parser import COMPARISONS

CLASH = "vector cannot contain metrics with the same labelset"


def _once(df: DataFrame, keys: list[str], values: list[str], text: str) -> DataFrame:
    """One row per key; a second one is an error when the row is made."""
    n = F.count(F.lit(1))
    picked = [F.first(c).alias(c) for c in values]
    out = df.groupBy(*keys).agg(n.alias("_n"), *picked)
    check = F.when(F.col("_n") > 1, F.raise_error(F.lit(text)).cast("double")).otherwise(F.col("v"))
    return out.withColumn("v", check).drop("_n")


def duplicates_fail(df: DataFrame) -> DataFrame:
    return _once(df.select("labels", "t", "v"), ["labels", "t"], ["v"], CLASH).select("labels", "t", "v")


def match_labels(on: tuple[str, ...] | None, ignoring: tuple[str, ...]) -> Column:
    return keep_labels(on) if on is not None else drop_labels([*ignoring, NAME])


def set_operation(op: str, a: DataFrame, b: DataFrame, on, ignoring) -> DataFrame:
    """``and`` is a semi-join, ``unless`` an anti-join, ``or`` adds the right rows without a match."""
    key = key_of(match_labels(on, ignoring))
    left, right = a.withColumn("_k", key), b.withColumn("_k", key)
    if op == "or":
        extra = right.join(left.select("_k", "t").distinct(), ["_k", "t"], "left_anti")
        return a.unionByName(extra.select("labels", "t", "v"))
    how = "left_semi" if op == "and" else "left_anti"
    return left.join(right.select("_k", "t"), ["_k", "t"], how).select("labels", "t", "v")


def vector_binary(node: Binary, a: DataFrame, b: DataFrame) -> DataFrame:
    """Arithmetic or comparison of matched samples; the "one" side of a match has one series per key and step."""
    match = match_labels(node.on, node.ignoring)
    swap = node.card == "right"
    many, one = (b, a) if swap else (a, b)
    left = many.select(key_of(match).alias("_k"), "t", "labels", "v")
    right = one.select(key_of(match).alias("_k"), "t", F.col("labels").alias("labels"), "v")
    right = _once(right, ["_k", "t"], ["labels", "v"], "found duplicate series for the match group on one side of the operation")
    if node.card == "one":
        left = _once(left, ["_k", "t"], ["labels", "v"], "found duplicate series for the match group on one side of the operation")
    right = right.select("_k", "t", F.col("labels").alias("_ol"), F.col("v").alias("_ov"))
    joined = left.join(right, ["_k", "t"])
    x, y = (F.col("_ov"), F.col("v")) if swap else (F.col("v"), F.col("_ov"))
    test = node.op in COMPARISONS
    if test and not node.bool_:
        joined = joined.where(compare(node.op, x, y))
        value = x
        name_kept = True
    else:
        value = F.when(compare(node.op, x, y), 1.0).otherwise(0.0) if test else arithmetic(node.op, x, y)
        name_kept = False
    if node.card == "one":
        labels = keep_labels(node.on) if node.on is not None else drop_labels(node.ignoring)
        labels = labels if name_kept and node.on is None else drop_name(labels)
    else:
        labels = F.col("labels") if name_kept else drop_name()
        if node.include:
            extra = F.map_filter("_ol", lambda k, v: k.isin(list(node.include)) & (v != ""))
            labels = F.map_concat(drop_labels(node.include, labels), extra)
    out = joined.select(labels.alias("labels"), "t", value.alias("v"))
    return out if node.card == "one" else duplicates_fail(out)

