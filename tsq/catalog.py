"""Catalog queries over sample frames: label names and values, series, metadata, exemplars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.model import NAME, key_of, label, match
from tsq.promql.parser import parse_selector


def _within(samples: DataFrame, match_texts, start: int | None, end: int | None) -> DataFrame:
    df = samples
    if start is not None:
        df = df.where(F.col("t") >= start)
    if end is not None:
        df = df.where(F.col("t") <= end)
    if match_texts:
        df = df.where(reduce(lambda a, b: a | b, [match(parse_selector(m).matchers) for m in match_texts]))
    return df


def label_names(samples: DataFrame, match_texts=(), start=None, end=None) -> DataFrame:
    return _within(samples, match_texts, start, end).select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")


def label_values(samples: DataFrame, name: str, match_texts=(), start=None, end=None) -> DataFrame:
    return _within(samples, match_texts, start, end).select(label(name).alias("value")).where("value <> ''").distinct().orderBy("value")


def series(samples: DataFrame, match_texts, start=None, end=None) -> DataFrame:
    """Label sets that any of the selectors picks."""
    return _within(samples, match_texts, start, end).select("labels").groupBy("labels").agg(F.lit(1).alias("_one")).select("labels")


def metadata(tables: list[DataFrame], metric: str = "", limit: int | None = None) -> DataFrame:
    """``(metric, type, help, unit)``: the first source that knows a metric wins; an empty name stands for all."""
    rows = reduce(DataFrame.unionByName, [t.select("metric", "type", "help", "unit", F.lit(k).alias("_k")) for k, t in enumerate(tables)])
    if metric:
        rows = rows.where(F.col("metric") == metric)
    best = rows.withColumn("_first", F.min("_k").over(_by_metric())).where("_k = _first").drop("_k", "_first").distinct()
    best = best.orderBy("metric", "type", "help", "unit")
    return best if limit is None else best.join(best.select("metric").distinct().orderBy("metric").limit(limit), "metric", "left_semi")


def _by_metric():
    from pyspark.sql import Window

    return Window.partitionBy("metric")


def exemplars(tables: list[DataFrame], query: str, start: int, end: int) -> DataFrame:
    """``(labels, ex_labels, v, t)`` for the series of any selector in the query, each exemplar once."""
    from tsq.promql.parser import parse, selectors

    chosen = [match(s.matchers) for s in selectors(parse(query))]
    if not chosen:
        raise ValueError("the query has no selector")
    rows = reduce(DataFrame.unionByName, [t.select("labels", "ex_labels", "v", "t") for t in tables])
    rows = rows.where((F.col("t") >= start) & (F.col("t") <= end) & reduce(lambda a, b: a | b, chosen))
    once = rows.groupBy(key_of().alias("_k"), key_of("ex_labels").alias("_e"), "v", "t").agg(F.first("labels").alias("labels"), F.first("ex_labels").alias("ex_labels"))
    return once.select("labels", "ex_labels", "v", "t")


__all__ = ["NAME", "exemplars", "label_names", "label_values", "metadata", "series"]
