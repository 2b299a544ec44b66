"""The sample model: label maps, their canonical keys, IEEE arithmetic on columns.

A vector is a DataFrame ``(labels map<string,string>, t bigint, v double)``; ``t`` is in milliseconds. A missing label
equals the empty string, so empty values are never stored. The metric name is the label ``__name__``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
NAN, INF = float("nan"), float("inf")
SAMPLE_SCHEMA = "labels map<string,string>, t bigint, v double, stale boolean"


def key_of(labels: str | Column = "labels") -> Column:
    """A map's sorted entries: orderable and joinable, which maps are not."""
    return F.sort_array(F.map_entries(labels))


def label(name: str, labels: str | Column = "labels") -> Column:
    labels = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def lit_map(values: Mapping[str, str]) -> Column:
    flat = [F.lit(x) for pair in sorted(values.items()) for x in pair]
    return F.create_map(*flat) if flat else empty_map()


def empty_map() -> Column:
    return F.expr("CAST(map() AS map<string,string>)")


def drop_labels(names: Iterable[str], labels: str | Column = "labels") -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, _: ~k.isin(names)) if names else (F.col(labels) if isinstance(labels, str) else labels)


def keep_labels(names: Iterable[str], labels: str | Column = "labels") -> Column:
    names = list(names)
    return F.map_filter(labels, lambda k, _: k.isin(names)) if names else empty_map()


def drop_name(labels: str | Column = "labels") -> Column:
    return drop_labels([NAME], labels)


def set_label(labels: Column, name: str, value: Column) -> Column:
    """The map with ``name`` set to ``value``, or without it where the value is empty."""
    rest = F.map_filter(labels, lambda k, _: k != F.lit(name))
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def with_labels(labels: Column, values: Mapping[str, str]) -> Column:
    """The map overwritten with fixed labels."""
    return F.map_concat(drop_labels(values, labels), lit_map(values)) if values else labels


def match(matchers, labels: str | Column = "labels") -> Column:
    """The conjunction of matchers; patterns are anchored at both ends and dots match line ends."""
    out = F.lit(True)
    for m in matchers:
        value = label(m.name, labels)
        if m.op in ("=", "!="):
            hit = value == F.lit(m.value)
        else:
            hit = value.rlike(f"(?s)^(?:{m.value})$")
        out = out & (hit if m.op in ("=", "=~") else ~hit)
    return out


def number(x) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else x


def is_negative(x: Column) -> Column:
    """True for negative numbers and for minus zero."""
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def divide(a: Column, b: Column) -> Column:
    """IEEE division; Spark's own raises or gives null at zero."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a < 0) == is_negative(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(F.isnan(b), F.lit(NAN)).when(b != 0, a / F.when(b != 0, b).otherwise(F.lit(1.0))).otherwise(zero)


def modulo(a: Column, b: Column) -> Column:
    """C's fmod."""
    bad = (b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF)
    return F.when(bad, F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(a % F.when((b == 0) | F.isnan(b), F.lit(1.0)).otherwise(b))


def compare(op: str, a: Column, b: Column) -> Column:
    """IEEE comparison: NaN equals nothing and is not greater than anything."""
    fine = ~F.isnan(a) & ~F.isnan(b)
    if op == "==":
        return fine & (a == b)
    if op == "!=":
        return ~fine | (a != b)
    return fine & {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return divide(a, b)
    if op == "%":
        return modulo(a, b)
    if op == "^":
        return F.pow(a, b)
    if op == "atan2":
        return F.atan2(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def finite_or(v: Column, out: Column) -> Column:
    """``out`` for finite values; NaN and infinities pass."""
    return F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(out)


def whole(v: Column, fn) -> Column:
    """``fn`` (floor or ceil) of a value; from 2**53 on every double is whole, and a long would not hold them all."""
    small = F.abs(v) < 2.0**53
    return F.when(small, fn(F.when(small, v)).cast("double")).otherwise(v)


def nan_max(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(NAN))


def format_value(v: float) -> str:
    """Shortest text of a float."""
    if v != v:
        return "NaN"
    if abs(v) == INF:
        return "+Inf" if v > 0 else "-Inf"
    if v == int(v) and abs(v) < 1e21:
        return str(int(v)) if v or str(v)[0] != "-" else "-0"
    text = repr(v)
    if "e" in text:
        mantissa, exponent = text.split("e")
        sign, digits = (exponent[0], exponent[1:]) if exponent[0] in "+-" else ("+", exponent)
        return f"{mantissa}e{sign}{digits.zfill(2)}"
    return text


def format_column(v: Column) -> Column:
    """Shortest text of a double in JVM expressions (plain digits below 1e21)."""
    whole = F.when((F.abs(v) < 9e15) & (v == F.floor(F.when(F.abs(v) < 9e15, v).otherwise(F.lit(0.0)))), F.when(F.abs(v) < 9e15, v).otherwise(F.lit(0.0)).cast("long").cast("string"))
    plain = F.when((F.abs(v) >= 1e-4) & (F.abs(v) < 1e21), F.regexp_replace(F.regexp_replace(v.cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))
    return F.when(F.isnan(v), "NaN").when(v == INF, "+Inf").when(v == -INF, "-Inf").otherwise(F.coalesce(whole, plain, F.lower(v.cast("string"))))
