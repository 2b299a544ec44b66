"""Functions of the samples in a window ``(T - range, T]``, reduced in two levels where they can be merged.

Time is cut into panes that window edges never cut. The first level reduces the samples of a (series, pane); its rows have
``ts``, ``v`` and, where a function looks at its neighbour, ``pts`` and ``pv``: the sample before, if the pane holds it, and
``i``, its place in the pane by time and, at one time, by value. The
second level reduces the panes of a (series, step); its rows are the first level's results with ``t``, ``lo`` (the window's
open start) and, again for neighbours, ``pts`` and ``pv``: the last sample before the pane. A pair counts in a window when
both its samples are inside. Functions that cannot be merged see each sample at every step whose window holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.model import divide, nan_max


@dataclass(frozen=True)
class Merged:
    """Aggregates of both levels by name; ``result(range)`` and ``test`` are over the second level's."""

    partial: dict[str, Column]
    final: dict[str, Column]
    result: Callable[[int], Column]
    test: Column | None = None


def _c(name: str) -> Column:
    return F.col(name)


def _crossing() -> Column:
    """Whether the last sample before the pane is in the window too."""
    return _c("pts") > _c("lo")


def _ends(place: str) -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "t0": F.min("ts"), "t1": F.max("ts"), "v0": F.min_by("v", place), "v1": F.max_by("v", place)}


def _merged_ends() -> dict[str, Column]:
    return {"n": F.sum("n"), "t0": F.min("t0"), "t1": F.max("t1"), "v0": F.min_by("v0", "t0"), "v1": F.max_by("v1", "t1"), "lo": F.first("lo")}


def stretched(delta: Column, range_ms: int, per_second: bool, zero: bool) -> Column:
    """A delta between first and last sample, extended towards the window's edges by at most half a mean gap where the
    samples stop short; with ``zero`` not below the point at which a counter would have been 0."""
    span = (_c("t1") - _c("t0")) / 1000.0
    mean = span / (_c("n") - 1)
    head, tail = (_c("t0") - _c("lo")) / 1000.0, (_c("t") - _c("t1")) / 1000.0
    head = F.when(head >= mean * 1.1, mean / 2).otherwise(head)
    if zero:
        since = F.when((delta > 0) & (_c("v0") >= 0), span * _c("v0") / F.when(delta > 0, delta).otherwise(F.lit(1.0)))
        head = F.least(head, F.coalesce(since, head))
    tail = F.when(tail >= mean * 1.1, mean / 2).otherwise(tail)
    out = delta * ((span + head + tail) / F.when(span > 0, span).otherwise(F.lit(1.0)))
    return out / (range_ms / 1000.0) if per_second else out


def _extrapolated(counter: bool, per_second: bool) -> Merged:
    partial, final = _ends("i" if counter else "ts"), _merged_ends()
    delta = _c("v1") - _c("v0")
    if counter:
        partial["fall"] = F.sum(F.when(_c("v") < _c("pv"), _c("pv")).otherwise(0.0))
        final["fall"] = F.sum(_c("fall") + F.when(_crossing() & (_c("v0") < _c("pv")), _c("pv")).otherwise(0.0))
        delta = delta + _c("fall")
    return Merged(partial, final, lambda r: stretched(delta, r, per_second, counter), _c("n") >= 2)


def _pair(fn: Callable[[Column, Column, Column], Column]) -> Merged:
    """A function of the last two samples, which differ in time."""
    partial = _ends("i") | {"last": F.max_by(F.struct("v", "ts", "pv", "pts"), "i")}
    before = [F.coalesce(_c(f"last.{k}"), _c(k)).alias(k) for k in ("pv", "pts")]
    final = {"last": F.max_by(F.struct(_c("last.v").alias("v"), _c("last.ts").alias("ts"), *before), "t1"), "lo": F.first("lo")}
    gap = (_c("last.ts") - _c("last.pts")) / 1000.0
    test = (_c("last.pts") > _c("lo")) & (_c("last.ts") > _c("last.pts"))
    return Merged(partial, final, lambda _: fn(_c("last.v"), _c("last.pv"), gap), test)


def _pairs_that(test: Callable[[Column, Column], Column]) -> Merged:
    """How many neighbours pass a test."""
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    partial = _ends("i") | {"x": F.sum(one(test(_c("v"), _c("pv"))))}
    return Merged(partial, {"x": F.sum(_c("x") + one(_crossing() & test(_c("v0"), _c("pv"))))}, lambda _: _c("x"))


def _alone(partial: dict[str, Column], final: Column, result: Column | None = None) -> Merged:
    return Merged(partial, {"x": final}, lambda _: _c("x") if result is None else result)


def _changed(v: Column, p: Column) -> Column:
    return (v != p) & ~(F.isnan(v) & F.isnan(p))


MERGED: dict[str, Callable[[], Merged]] = {
    "rate": lambda: _extrapolated(True, True),
    "increase": lambda: _extrapolated(True, False),
    "delta": lambda: _extrapolated(False, False),
    "irate": lambda: _pair(lambda v, p, s: divide(F.when(v < p, v).otherwise(v - p), s)),
    "idelta": lambda: _pair(lambda v, p, s: v - p),
    "changes": lambda: _pairs_that(_changed),
    "resets": lambda: _pairs_that(lambda v, p: v < p),
    "avg_over_time": lambda: _alone({"s": F.sum("v"), "n": F.count(F.lit(1))}, F.sum("s") / F.sum("n")),
    "min_over_time": lambda: _alone({"x": F.min("v")}, F.min("x")),
    "max_over_time": lambda: _alone({"x": nan_max("v")}, nan_max("x")),
    "sum_over_time": lambda: _alone({"x": F.sum("v")}, F.sum("x")),
    "count_over_time": lambda: _alone({"x": F.count(F.lit(1))}, F.sum("x").cast("double")),
    "last_over_time": lambda: _alone({"t1": F.max("ts"), "v1": F.max_by("v", "ts")}, F.max_by("v1", "t1")),
    "first_over_time": lambda: _alone({"t0": F.min("ts"), "v0": F.min_by("v", "ts")}, F.min_by("v0", "t0")),
    "present_over_time": lambda: _alone({"x": F.max(F.lit(1.0))}, F.max("x")),
    "ts_of_last_over_time": lambda: _alone({"x": F.max("ts")}, F.max("x") / 1000.0),
    "ts_of_first_over_time": lambda: _alone({"x": F.min("ts")}, F.min("x") / 1000.0),
    "ts_of_min_over_time": lambda: _alone({"x": F.min(F.struct(F.isnan("v").alias("nan"), "v", (-_c("ts")).alias("back")))}, F.min("x"), -_c("x.back") / 1000.0),
    "ts_of_max_over_time": lambda: _alone({"x": F.max(F.struct((~F.isnan("v")).alias("some"), "v", "ts"))}, F.max("x"), _c("x.ts") / 1000.0),
}

#: Functions that look at the sample before.
PAIRED = {"rate", "increase", "irate", "idelta", "changes", "resets"}
#: Functions whose result keeps the metric name.
KEEPS_NAME = {"last_over_time", "first_over_time"}


def _regression(at: float | None):
    """Slope by time, or with ``at`` the line's value so many seconds after the step."""
    seconds = (_c("ts") - _c("t")) / 1000.0
    aggs = {"n": F.count(F.lit(1)), "slope": F.regr_slope(_c("v"), seconds), "icpt": F.regr_intercept(_c("v"), seconds)}
    return aggs, _c("slope") if at is None else _c("icpt") + _c("slope") * F.lit(at), _c("n") >= 2


#: name -> aggregates over the samples of a (series, step), result and test; arguments are the call's constants.
WHOLE: dict[str, Callable[..., tuple]] = {
    "deriv": lambda: _regression(None),
    "predict_linear": lambda at: _regression(at),
    "stddev_over_time": lambda: ({"x": F.stddev_pop("v")}, _c("x"), None),
    "stdvar_over_time": lambda: ({"x": F.var_pop("v")}, _c("x"), None),
    "quantile_over_time": lambda phi: ({"x": quantile_of(phi)}, _c("x"), None),
    "mad_over_time": lambda: median_deviation(),
    "double_exponential_smoothing": lambda sf, tf: smoothing(sf, tf),
    "holt_winters": lambda sf, tf: smoothing(sf, tf),
}


def quantile_of(phi: float, v: str | Column = "v") -> Column:
    """Exact quantile with linear interpolation; outside 0..1 the infinities."""
    if phi != phi:
        return F.max(F.lit(float("nan")))
    if phi < 0 or phi > 1:
        return F.max(F.lit(float("-inf") if phi < 0 else float("inf")))
    return F.percentile(v, F.lit(phi))


def median_deviation() -> tuple:
    aggs = {"mid": F.percentile("v", F.lit(0.5)), "all": F.collect_list("v")}
    ordered = F.array_sort(F.transform("all", lambda x: F.abs(x - F.col("mid"))))
    n = F.size("all")
    low, high = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return aggs, (F.get(ordered, low) + F.get(ordered, high)) / 2, None


def smoothing(sf: float, tf: float) -> tuple:
    """Double exponential smoothing over the samples in time order."""
    aggs = {"all": F.array_sort(F.collect_list(F.struct("ts", "v")))}
    x = F.transform("all", lambda r: r["v"])
    state = F.struct(F.get(x, F.lit(0)).alias("s"), (F.get(x, F.lit(1)) - F.get(x, F.lit(0))).alias("b"))

    def step(a, v):
        s = F.lit(sf) * v + F.lit(1 - sf) * (a["s"] + a["b"])
        b = F.lit(tf) * (s - a["s"]) + F.lit(1 - tf) * a["b"]
        return F.struct(s.alias("s"), b.alias("b"))

    return aggs, F.aggregate(F.slice(x, F.lit(2), F.size(x)), state, step, lambda a: a["s"]), F.size("all") >= 2
