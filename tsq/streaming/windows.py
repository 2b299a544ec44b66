"""Structured Streaming forms of the time-driven parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALGEBRAIC = {
    "sum_over_time": lambda: F.sum("v"),
    "count_over_time": lambda: F.count(F.lit(1)).cast("double"),
    "avg_over_time": lambda: F.avg("v"),
    "min_over_time": lambda: F.min("v"),
    "max_over_time": lambda: F.max("v"),
    "last_over_time": lambda: F.max_by("v", "ts"),
}


def sliding(stream: DataFrame, function: str, range_: str, step: str, late: str, keys: list[str]) -> DataFrame:
    """A window function of ``(ts timestamp, v, keys...)`` at every step, rows up to ``late`` behind still counting.

    A series has one sample at a time: repeats of it inside the watermark are dropped.
    """
    once = stream.withWatermark("ts", late).dropDuplicates([*keys, "ts"])
    spread = once.groupBy(F.window("ts", range_, step), *keys)
    return spread.agg(ALGEBRAIC[function]().alias("v")).select(F.col("window.end").alias("t"), *keys, "v")


def latest_with_ttl(stream: DataFrame, key: str, ttl: str, late: str = "0 seconds") -> DataFrame:
    """The newest sample by series, forgotten when nothing newer came for ``ttl``; update mode."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def keep(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else (-(2**62), 0.0)
        before = best
        for b in batches:
            ms = b["ts"].astype("datetime64[ms]").astype("int64")
            k = int(ms.to_numpy().argmax())
            best = max(best, (int(ms.iloc[k]), float(b["v"].iloc[k])))
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if best != before:
            yield pd.DataFrame({key: [name[0]], "t": [best[0]], "v": [best[1]]})

    rows = stream.withWatermark("ts", late).select(key, "ts", "v")
    return rows.groupBy(key).applyInPandasWithState(keep, f"{key} string, t bigint, v double", "t bigint, v double", "update", GroupStateTimeout.EventTimeTimeout)


def alert_states(stream: DataFrame, key: str, for_: str, step: str, late: str = "0 seconds") -> DataFrame:
    """``(key, t, active_at, state)`` in ms for a stream ``(key, ts timestamp)`` of the steps at which an alert's rule held.

    An alert is pending until its rule has held for ``for_`` without a gap of more than a step, then firing. State is the run's
    start and last step; it goes when the watermark has passed the next step without a sample.
    """
    for_ms, step_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (for_, step))

    def follow(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        active, last = state.get if state.exists else (None, None)
        out = []
        times = sorted({int(t) for b in batches for t in b["ts"].astype("datetime64[ms]").astype("int64")})
        for t in times:
            if last is not None and t <= last:
                continue  # a step that was counted before
            if last is None or t - last > step_ms:
                active = t
            last = t
            out.append((name[0], t, active, "firing" if t - active >= for_ms else "pending"))
        if last is None:
            return
        state.update((active, last))
        state.setTimeoutTimestamp(max(last + step_ms + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "t", "active_at", "state"])

    rows = stream.withWatermark("ts", late).select(key, "ts")
    schema = f"{key} string, t bigint, active_at bigint, state string"
    return rows.groupBy(key).applyInPandasWithState(follow, schema, "active bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def evaluate_rules(stream: DataFrame, rules, engine_of, sink, step_ms: int, checkpoint: str, lag_ms: int = 0):
    """Runs rules for the steps that each micro-batch completes: ``engine_of(batch)`` gives the engine over the data."""

    def each(batch: DataFrame, _: int) -> None:
        edge = batch.agg(F.min("t"), F.max("t")).first()
        if edge[1] is None:
            return
        first, last = -(-edge[0] // step_ms) * step_ms, (edge[1] - lag_ms) // step_ms * step_ms
        if last < first:
            return
        engine = engine_of(batch)
        for rule in rules:
            sink(rule.evaluate(engine, first, last, step_ms))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
