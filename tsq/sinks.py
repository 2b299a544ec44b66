"""Outputs: newest samples as exposition text, JSON envelopes in and out, sample tables, a discarding sink."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.model import NAME, drop_labels, drop_name, format_column, format_value, label, match
from tsq.operators.histogram import HISTOGRAM
from tsq.promql.parser import parse_selector

log = logging.getLogger(__name__)


def latest(samples: DataFrame, low: int | None = None, high: int | None = None, ttl: int | None = None) -> DataFrame:
    """The newest sample of every series, unless it is a stale mark; with ``ttl`` it is forgotten that long before ``high``."""
    df = samples
    if ttl is not None:
        if high is None:
            raise ValueError("a time to live counts back from the end of the range")
        low = high - ttl if low is None else max(low, high - ttl)
    if low is not None:
        df = df.where(F.col("t") >= low)
    if high is not None:
        df = df.where(F.col("t") <= high)
    newest = df.groupBy("labels").agg(F.max_by(F.struct("v", "stale"), "t").alias("x"), F.max("t").alias("t"))
    return newest.where(~F.col("x.stale")).select("labels", "t", F.col("x.v").alias("v"))


def federate(samples: DataFrame, match_texts: list[str], now: int, lookback: int = 300_000, external: Mapping[str, str] | None = None) -> DataFrame:
    """Newest samples of the chosen series by name, external labels filled in where absent, ``instance`` at least empty."""
    chosen = F.lit(False)
    for m in match_texts:
        chosen = chosen | match(parse_selector(m).matchers)
    df = latest(samples.where(chosen), now - lookback, now)
    labels = F.col("labels")
    for k, v in sorted({"instance": "", **(external or {})}.items()):
        own = label(k, labels)
        labels = F.when(own == "", F.map_concat(drop_labels([k], labels), F.create_map(F.lit(k), F.lit(v)))).otherwise(labels)
    return df.withColumn("labels", labels).orderBy(label(NAME), F.array_sort(F.map_entries("labels")))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(df: DataFrame) -> DataFrame:
    """One text line per sample; names and label names that are not plain are quoted."""
    entries = F.array_sort(F.map_entries(drop_name()))
    plain = r"^[A-Za-z_][A-Za-z0-9_]*$"
    pair = lambda e: F.concat(F.when(e["key"].rlike(plain), e["key"]).otherwise(F.concat(F.lit('"'), _escaped(e["key"]), F.lit('"'))), F.lit('="'), _escaped(e["value"]), F.lit('"'))
    body = F.array_join(F.transform(entries, pair), ",")
    name = label(NAME)
    legal = name.rlike(r"^[A-Za-z_:][A-Za-z0-9_:]*$")
    head = F.when(legal, F.concat(name, F.when(body == "", "").otherwise(F.concat(F.lit("{"), body, F.lit("}"))))).otherwise(
        F.concat(F.lit('{"'), _escaped(name), F.lit('"'), F.when(body == "", "").otherwise(F.concat(F.lit(","), body)), F.lit("}"))
    )
    return df.select(name.alias("metric"), F.concat_ws(" ", head, format_column(F.col("v")), F.col("t").cast("string")).alias("line"))


def exposition_text(df: DataFrame) -> str:
    """The whole text with a type line per metric, for results that fit the driver."""
    out, last = [], None
    for r in exposition(df).orderBy("metric", "line").toLocalIterator():
        if r["metric"] != last:
            last = r["metric"]
            out.append(f"# TYPE {last} untyped")
        out.append(r["line"])
    return "".join(x + "\n" for x in out)


def json_pieces(df: DataFrame, kind: str, warnings=()) -> Iterator[str]:
    """The JSON envelope of a result, piece by piece; ``kind`` is vector, matrix or scalar.

    Rows are put together by series on the executors and pass the driver one partition at a time. ``h``, if there, holds
    native histograms.
    """
    own = df if "h" in df.columns else df.withColumn("h", F.lit(None).cast(HISTOGRAM))
    yield f'{{"status": "success", "data": {{"resultType": "{kind}", "result": '
    if kind == "scalar":
        yield json.dumps(_pair(own.first()))
    else:
        rows = own.select(F.sort_array(F.map_entries("labels")).alias("key"), F.struct("t", "v", "h").alias("x"))
        if kind == "matrix":
            rows = rows.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("x"))
        yield "["
        for k, r in enumerate(rows.orderBy("key").toLocalIterator()):
            out: dict = {"metric": {e["key"]: e["value"] for e in r["key"]}}
            every = r["x"] if kind == "matrix" else [r["x"]]
            for name, found in (("value", [_pair(x) for x in every if x["h"] is None]), ("histogram", [[x["t"] / 1000, _histogram(x["h"])] for x in every if x["h"] is not None])):
                if found:
                    out |= {f"{name}s": found} if kind == "matrix" else {name: found[0]}
            yield ", " * bool(k) + json.dumps(out)
        yield "]"
    yield "}" + (f', "warnings": {json.dumps(list(warnings))}' if warnings else "") + "}"


def _pair(r) -> list:
    return [r["t"] / 1000, format_value(r["v"])]


def _histogram(h) -> dict:
    """Buckets are open below, those below zero open above, and one around zero closed."""
    edge = lambda b: 3 if b["lower"] < 0 < b["upper"] else 1 if b["lower"] < 0 else 0
    buckets = [[edge(b), *(format_value(b[c]) for c in ("lower", "upper", "n"))] for b in h["buckets"]]
    return {"count": format_value(h["count"]), "sum": format_value(h["sum"]), "buckets": buckets}


def to_json(df: DataFrame, kind: str, warnings=()) -> str:
    """The whole envelope, for results that fit the driver."""
    return "".join(json_pieces(df, kind, warnings))


def from_json(spark: SparkSession, body: str) -> tuple[DataFrame, set[str]]:
    """``(labels, t, v, h)`` and the warnings of an envelope; an error envelope raises, a text gives a series named by it."""
    data = json.loads(body)
    if data.get("status") != "success":
        raise ValueError(f"{data.get('errorType', 'error')}: {data.get('error', '')}")
    kind, result = data["data"]["resultType"], data["data"]["result"]
    if kind == "scalar":
        found = [({}, [result], [])]
    elif kind == "string":
        found = [({"__text__": result[1]}, [[result[0], "NaN"]], [])]
    elif kind == "vector":
        found = [(r["metric"], [r[x] for x in ("value",) if x in r], [r[x] for x in ("histogram",) if x in r]) for r in result]
    elif kind == "matrix":
        found = [(r["metric"], r.get("values", []), r.get("histograms", [])) for r in result]
    else:
        raise ValueError(f"unknown result type {kind}")
    rows = [(m, round(float(t) * 1000), float(v), None) for m, pairs, _ in found for t, v in pairs]
    for m, _, pairs in found:
        for t, h in pairs:
            buckets = [tuple(map(float, b[1:])) for b in h.get("buckets", ())]
            rows.append((m, round(float(t) * 1000), None, (float(h["count"]), float(h["sum"]), buckets)))
    return spark.createDataFrame(rows, f"labels map<string,string>, t bigint, v double, h {HISTOGRAM}"), {*data.get("warnings", ()), *data.get("infos", ())}


def write_samples(df: DataFrame, path: str) -> None:
    """Appends samples to a table, a directory by metric and day, so readers of few names or days skip the others."""
    day = F.to_date(F.timestamp_millis("t"))
    df.withColumns({"metric": label(NAME), "day": day}).write.mode("append").partitionBy("metric", "day").parquet(path)


class NullSink:
    """Takes rule results where no table is configured: they are dropped, with one warning."""

    def __init__(self) -> None:
        self.warned = False

    def write(self, df: DataFrame) -> None:
        if not self.warned:
            log.warning("no sample table is configured; rule results are dropped")
            self.warned = True

