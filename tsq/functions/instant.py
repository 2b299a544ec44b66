"""Functions of one value at one time: math, rounding, dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.model import INF, NAN, divide, finite_or, whole


def _log(fn):
    def build(v: Column) -> Column:
        return F.when(F.isnan(v), v).when(v > 0, fn(F.when(v > 0, v).otherwise(F.lit(1.0)))).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))

    return build


def _domain(fn, test):
    def build(v: Column) -> Column:
        return F.when(test(v), fn(F.when(test(v), v))).otherwise(F.lit(NAN))

    return build


def round_to(v: Column, to: Column) -> Column:
    """Nearest multiple, ties up."""
    inverse = divide(F.lit(1.0), to)
    return finite_or(v, divide(whole(v * inverse + 0.5, F.floor), inverse))


def clamp_min(v: Column, low: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(low), F.lit(NAN)).otherwise(F.greatest(v, low))


def clamp_max(v: Column, high: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(high), F.lit(NAN)).otherwise(F.least(v, high))


def _inverse_hyperbolic_sine(v: Column) -> Column:
    return finite_or(v, F.asinh(v))


MATH = {
    "abs": F.abs,
    "ceil": lambda v: whole(v, F.ceil),
    "floor": lambda v: whole(v, F.floor),
    "exp": F.exp,
    "ln": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "sqrt": F.sqrt,
    "sgn": F.signum,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": _domain(F.asin, lambda v: F.abs(v) <= 1),
    "acos": _domain(F.acos, lambda v: F.abs(v) <= 1),
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": _inverse_hyperbolic_sine,
    "acosh": _domain(F.acosh, lambda v: v >= 1),
    "atanh": _domain(F.atanh, lambda v: F.abs(v) < 1),
    "deg": F.degrees,
    "rad": F.radians,
}


def _date(fn):
    def build(v: Column) -> Column:
        bad = F.isnan(v) | (F.abs(v) == INF)
        when = F.timestamp_seconds(F.floor(F.when(~bad, v)).cast("long"))
        return F.when(bad, F.lit(NAN)).otherwise(fn(when).cast("double"))

    return build


#: The session's time zone has to be UTC.
DATES = {
    "minute": _date(F.minute),
    "hour": _date(F.hour),
    "day_of_week": _date(lambda x: F.dayofweek(x) - 1),
    "day_of_month": _date(F.dayofmonth),
    "day_of_year": _date(F.dayofyear),
    "days_in_month": _date(lambda x: F.dayofmonth(F.last_day(x))),
    "month": _date(F.month),
    "year": _date(F.year),
}

PI = math.pi
