"""Registered queries over the benchmark tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsq.model import NAME, label
from tsq.plans.engine import Engine
from tsq.sources.tables import driver_catalog

DAY = 86_400_000
START = 1_704_067_200_000  # 2024-01-01
END = START + 30 * DAY
LINE_START = 788_918_400_000  # 1995-01-01

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, lookback: int = DAY) -> Engine:
    return Engine(spark, driver_catalog(spark, sf_dir).scan, lookback=lookback, default_step=DAY)


def project(df: DataFrame, labels: tuple[str, ...], *more: str) -> DataFrame:
    """Labels as columns (``name`` is the metric name), and values rounded as in the oracle."""
    cols = [label(NAME if c == "name" else c).alias(c) for c in labels]
    return df.select(*cols, "t", (F.round("v", 6) + F.lit(0.0)).alias("v"), *more)


def register(key: str, text: str, labels: tuple[str, ...], oracle: str | None, at: int | None = None, start: int = START + DAY, end: int = END, step: int = DAY, lookback: int = DAY) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, lookback)
        return project(e.query(text, at) if at is not None else e.query_range(text, start, end, step), labels)

    QUERIES[key] = run
    if oracle is not None:
        cols = ", ".join([*labels, "t"])
        ORACLES[key] = f"{WITH}{oracle.strip().rstrip(';')}" if "FINAL" not in oracle else WITH + oracle.replace("FINAL", f"SELECT {cols}, round(v, 6) + 0.0 AS v FROM")


def views(start: int = START + DAY, end: int = END, step: int = DAY, window: int = DAY) -> str:
    """Sample views, the step grid, per-series windows and the newest sample in them."""
    return f"""
WITH e AS (SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS shard, epoch_us(ts) // 1000 AS ts, value AS v FROM events),
g AS (SELECT {start} + i * {step} AS t FROM range(0, {(end - start) // step + 1}) r(i)),
w AS (SELECT event_type, shard, g.t, g.t - {window} AS lo, e.ts, e.v,
             lag(e.ts) OVER p AS pts, lag(e.v) OVER p AS pv
      FROM e JOIN g ON e.ts > g.t - {window} AND e.ts <= g.t WINDOW p AS (PARTITION BY event_type, shard, g.t ORDER BY e.ts)),
iv AS (SELECT event_type, shard, t, arg_max(v, ts) AS v, max(ts) AS ts FROM w GROUP BY ALL),
x AS (SELECT event_type, shard, t, lo, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(v, ts) AS v0, arg_max(v, ts) AS v1,
             sum(CASE WHEN v < pv THEN pv ELSE 0 END) AS fall, sum(CASE WHEN v < pv THEN 1.0 ELSE 0 END) AS resets,
             sum(CASE WHEN v <> pv THEN 1.0 ELSE 0 END) AS changes, arg_max(pv, ts) AS lpv, arg_max(pts, ts) AS lpts,
             regr_slope(v, (ts - t) / 1e3) AS slope, regr_intercept(v, (ts - t) / 1e3) AS icpt,
             avg(v) AS a, min(v) AS mn, max(v) AS mx, sum(v) AS s, stddev_pop(v) AS sd, var_pop(v) AS var, quantile_cont(v, 0.9) AS q,
             quantile_cont(v, 0.5) AS med
      FROM w GROUP BY event_type, shard, t, lo),
h AS (SELECT *, (t1 - t0) / 1e3 AS span, (t0 - lo) / 1e3 AS head, (t - t1) / 1e3 AS tail FROM x WHERE n >= 2),
k AS (SELECT *, span / (n - 1) AS mean, v1 - v0 + fall AS dc, v1 - v0 AS dd FROM h),
r AS (SELECT event_type, shard, t, dc, dd, span,
             least(CASE WHEN head >= mean * 1.1 THEN mean / 2 ELSE head END,
                   CASE WHEN dc > 0 AND v0 >= 0 THEN span * v0 / dc ELSE 1e300 END) AS ch,
             CASE WHEN head >= mean * 1.1 THEN mean / 2 ELSE head END AS dh,
             CASE WHEN tail >= mean * 1.1 THEN mean / 2 ELSE tail END AS tl FROM k),
inc AS (SELECT event_type, shard, t, dc * ((span + ch + tl) / span) AS v FROM r),
del AS (SELECT event_type, shard, t, dd * ((span + dh + tl) / span) AS v FROM r)
"""


#: The views over day steps and windows of January 2024.
WITH = views()

ES = ("event_type", "shard")
E_ = ("event_type",)
M = "event_value"
R = f"{M}[1d]"

register("rate_grid", f"sum by (event_type) (rate({R}))", E_, f"FINAL (SELECT event_type, t, sum(v / {DAY // 1000}e0) AS v FROM inc GROUP BY ALL)")
register("increase", f"increase({R})", ES, "FINAL inc")
register("delta", f"delta({R})", ES, "FINAL del")
register("irate", f"irate({R})", ES, "FINAL (SELECT event_type, shard, t, (CASE WHEN v1 < lpv THEN v1 ELSE v1 - lpv END) / ((t1 - lpts) / 1e3) AS v FROM k)")
register("idelta", f"idelta({R})", ES, "FINAL (SELECT event_type, shard, t, v1 - lpv AS v FROM k)")
register("deriv", f"deriv({R})", ES, "FINAL (SELECT event_type, shard, t, slope AS v FROM k)")
register("predict_linear", f"predict_linear({R}, 3600)", ES, "FINAL (SELECT event_type, shard, t, icpt + slope * 3600 AS v FROM k)")
register("changes", f"changes({R})", ES, "FINAL (SELECT event_type, shard, t, changes AS v FROM x)")
register("resets", f"resets({R})", ES, "FINAL (SELECT event_type, shard, t, resets AS v FROM x)")
for _f, _c in {"avg": "a", "min": "mn", "max": "mx", "sum": "s", "count": "n::DOUBLE", "last": "v1", "first": "v0", "present": "1.0", "stddev": "sd", "stdvar": "var"}.items():
    register(f"{_f}_over_time", f"{_f}_over_time({R})", ES, f"FINAL (SELECT event_type, shard, t, {_c} AS v FROM x)")
register("quantile_over_time", f"quantile_over_time(0.9, {R})", ES, "FINAL (SELECT event_type, shard, t, q AS v FROM x)")
register("mad_over_time", f"mad_over_time({R})", ES, "FINAL (SELECT w.event_type, w.shard, w.t, quantile_cont(abs(w.v - x.med), 0.5) AS v FROM w JOIN x USING (event_type, shard, t) GROUP BY ALL)")
register("ts_of_max_over_time", f"ts_of_max_over_time({R})", ES, "FINAL (SELECT event_type, shard, t, max(ts) / 1e3 AS v FROM (SELECT w.*, max(v) OVER (PARTITION BY event_type, shard, t) AS top FROM w) WHERE v = top GROUP BY ALL)")

register("instant_selector", M, ES, f"FINAL (SELECT event_type, shard, t, v FROM iv WHERE t = {START + 10 * DAY})", at=START + 10 * DAY)
register("range_instant_grid", M, ES, "FINAL iv")
register("matcher_equal", f'{M}{{event_type="click"}}', ES, "FINAL (SELECT * FROM iv WHERE event_type = 'click')")
register("matcher_regex", f'{{__name__=~"event_v.*", event_type=~"c.*|p.*"}}', ("name", *ES), "FINAL (SELECT 'event_value' AS name, * FROM iv WHERE regexp_full_match(event_type, 'c.*|p.*'))")
register("matcher_negative", f'{M}{{event_type!="click", shard!~"[0-4]"}}', ES, "FINAL (SELECT * FROM iv WHERE event_type <> 'click' AND NOT regexp_full_match(shard, '[0-4]'))")
register("matcher_empty", f'{M}{{nolabel="", event_type!=""}}', ES, "FINAL iv")
_SHIFT = "FINAL (SELECT event_type, shard, g.t, arg_max(e.v, e.ts) AS v FROM e JOIN g ON e.ts > g.t - {0} - {1} AND e.ts <= g.t - {0} GROUP BY ALL)"
register("offset_selector", f"{M} offset 12h", ES, _SHIFT.format(DAY // 2, DAY))
register("negative_offset", f"{M} offset -6h", ES, _SHIFT.format(-DAY // 4, DAY))
register("at_modifier", f"{M} @ {(START + 5 * DAY) // 1000}", ES, f"FINAL (SELECT iv.event_type, iv.shard, g.t, iv.v FROM iv, g WHERE iv.t = {START + 5 * DAY})")
register("timestamp_fn", f"timestamp({M})", ES, "FINAL (SELECT event_type, shard, t, ts / 1e3 AS v FROM iv)")

for _f, _s in {"sum": "sum(v)", "min": "min(v)", "max": "max(v)", "avg": "avg(v)", "count": "count(*)::DOUBLE", "group": "1.0", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    register(f"{_f}_by", f"{_f} by (event_type) ({M})", E_, f"FINAL (SELECT event_type, t, {_s} AS v FROM iv GROUP BY ALL)")
register("sum_without", f"sum without (event_type) ({M})", ("shard",), "FINAL (SELECT shard, t, sum(v) AS v FROM iv GROUP BY ALL)")
register("quantile_by", f"quantile by (event_type) (0.75, {M})", E_, "FINAL (SELECT event_type, t, quantile_cont(v, 0.75) AS v FROM iv GROUP BY ALL)")
register("count_values", f'count_values by (event_type) ("val", floor({M} / 20))', ("event_type", "val"), "FINAL (SELECT event_type, CAST(CAST(floor(v / 20) AS BIGINT) AS VARCHAR) AS val, t, count(*)::DOUBLE AS v FROM iv GROUP BY ALL)")
_TOP = "FINAL (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY v {}, shard) AS k FROM iv) WHERE k <= 3)"
register("topk_by", f"topk by (event_type) (3, {M})", ES, _TOP.format("DESC"))
register("bottomk_by", f"bottomk by (event_type) (3, {M})", ES, _TOP.format("ASC"))
register("vector_arith", f"({M} * 2 + 1) / 7 - {M} ^ 0.5", ES, "FINAL (SELECT event_type, shard, t, (v * 2 + 1) / 7 - v ^ 0.5 AS v FROM iv)")
register("vector_modulo", f"{M} % 7", ES, "FINAL (SELECT event_type, shard, t, fmod(v, 7) AS v FROM iv)")
register("vector_atan2", f"{M} atan2 ({M} + 1)", ES, "FINAL (SELECT event_type, shard, t, atan2(v, v + 1) AS v FROM iv)")
register("vector_compare", f"{M} > 50", ES, "FINAL (SELECT * FROM iv WHERE v > 50)")
register("vector_bool", f"{M} <= bool 50", ES, "FINAL (SELECT event_type, shard, t, CASE WHEN v <= 50 THEN 1.0 ELSE 0.0 END AS v FROM iv)")
register("div_by_zero", f"sum by (event_type) ({M} / 0 > 1)", E_, "FINAL (SELECT event_type, t, 'inf'::DOUBLE AS v FROM iv WHERE v > 0 GROUP BY ALL)")
register("unary_minus", f"-{M}", ES, "FINAL (SELECT event_type, shard, t, -v AS v FROM iv)")
register("match_on", f"sum by (event_type) ({M}) / on (event_type) count by (event_type) ({M})", E_, "FINAL (SELECT event_type, t, sum(v) / count(*) AS v FROM iv GROUP BY ALL)")
register("match_ignoring", f'{M}{{shard="1"}} - ignoring (shard) {M}{{shard="2"}}', E_, "FINAL (SELECT a.event_type, a.t, a.v - b.v AS v FROM iv a JOIN iv b USING (event_type, t) WHERE a.shard = '1' AND b.shard = '2')")
register("group_left", f"{M} / on (event_type) group_left () sum by (event_type) ({M})", ES, "FINAL (SELECT event_type, shard, t, v / sum(v) OVER (PARTITION BY event_type, t) AS v FROM iv)")
register("scalar_op", f"{M} - scalar(avg({M}))", ES, "FINAL (SELECT event_type, shard, t, v - avg(v) OVER (PARTITION BY t) AS v FROM iv)")
register("set_and", f"{M} and ({M} > 50)", ES, "FINAL (SELECT * FROM iv WHERE v > 50)")
register("set_unless", f"{M} unless ({M} > 50)", ES, "FINAL (SELECT * FROM iv WHERE NOT v > 50)")
register("set_or", f"({M} > 80) or ({M} < 20)", ES, "FINAL (SELECT * FROM iv WHERE v > 80 OR v < 20)")
register("absent", f'absent({M}{{event_type="click", shard="3"}})', ES, "FINAL (SELECT 'click' AS event_type, '3' AS shard, t, 1.0 AS v FROM g WHERE t NOT IN (SELECT t FROM iv WHERE event_type = 'click' AND shard = '3'))")
register("absent_over_time", f'absent_over_time({M}{{event_type="click", shard="3"}}[1h])', ES, f"FINAL (SELECT 'click' AS event_type, '3' AS shard, t, 1.0 AS v FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.event_type = 'click' AND e.shard = '3' AND e.ts > g.t - 3600000 AND e.ts <= g.t))")
register("subquery_max_of_sum", f"max_over_time(sum by (event_type) ({M})[3d:1d])", E_, f"FINAL (SELECT s.event_type, g.t, max(s.v) AS v FROM (SELECT event_type, t, sum(v) AS v FROM iv GROUP BY ALL) s JOIN g ON s.t > g.t - {3 * DAY} AND s.t <= g.t GROUP BY ALL)")
register("label_replace", f'label_replace({M}, "kind", "$1-x", "event_type", "(..).*")', ("event_type", "shard", "kind"), "FINAL (SELECT event_type, shard, regexp_replace(event_type, '^(..).*$', '\\1-x') AS kind, t, v FROM iv)")
register("label_join", f'label_join({M}, "pair", "/", "event_type", "shard")', ("event_type", "shard", "pair"), "FINAL (SELECT event_type, shard, event_type || '/' || shard AS pair, t, v FROM iv)")
register("sort_desc", f"sort_desc({M})", ES, f"FINAL (SELECT * FROM iv WHERE t = {START + 10 * DAY})", at=START + 10 * DAY)
_MATH = {"abs(-V)": "abs(v)", "ceil(V)": "ceil(v)", "floor(V)": "floor(v)", "exp(V / 100)": "exp(v / 100)", "ln(V)": "ln(v)", "log2(V)": "log2(v)", "log10(V)": "log10(v)", "sqrt(V)": "sqrt(v)", "sgn(V)": "sign(v)"}
_TRIG = {"sin(V)": "sin(v)", "cos(V)": "cos(v)", "tan(V / 100)": "tan(v / 100)", "asin(V / 1e6)": "asin(v / 1e6)", "acos(V / 1e6)": "acos(v / 1e6)", "atan(V)": "atan(v)", "sinh(V / 1e3)": "sinh(v / 1e3)", "cosh(V / 1e3)": "cosh(v / 1e3)", "tanh(V)": "tanh(v)", "asinh(V)": "asinh(v)", "acosh(V + 1)": "acosh(v + 1)", "atanh(V / 1e6)": "atanh(v / 1e6)", "deg(V)": "degrees(v)", "rad(V)": "radians(v)"}
_ROUND = {"round(V, 5)": "floor(v / 5 + 0.5) * 5", "clamp(V, 10, 50)": "least(greatest(v, 10), 50)", "clamp_min(V, 30)": "greatest(v, 30)", "clamp_max(V, 30)": "least(v, 30)"}
for _key, _set in (("math_funcs", _MATH), ("trig_funcs", _TRIG), ("round_clamp", _ROUND)):
    register(_key, " + ".join(k.replace("V", M) for k in _set), ES, f"FINAL (SELECT event_type, shard, t, {' + '.join(_set.values())} AS v FROM iv WHERE v > 0)" if _key == "math_funcs" else f"FINAL (SELECT event_type, shard, t, {' + '.join(_set.values())} AS v FROM iv)")
_D = "to_timestamp(floor(ts / 1e3)) AT TIME ZONE 'UTC'"
register("date_funcs", " + ".join(f"{k} * {f}(timestamp({M}))" for f, k in {"minute": 1, "hour": 100, "day_of_week": 1e4, "day_of_month": 1e5, "day_of_year": 1e7, "days_in_month": 1e10, "month": 1e12, "year": 1e-3}.items()).replace("e+", "e"), ES, f"FINAL (SELECT event_type, shard, t, 1.0 * minute(d) + 100.0 * hour(d) + 1e4 * dayofweek(d) + 1e5 * day(d) + 1e7 * dayofyear(d) + 1e10 * day(last_day(d)) + 1e12 * month(d) + 1e-3 * year(d) AS v FROM (SELECT *, {_D} AS d FROM iv))")
register("scalar_vector_fn", "vector(scalar(sum(event_value)) + time())", (), "FINAL (SELECT t, sum(v) + t / 1e3 AS v FROM iv GROUP BY t)")

# -- parameters, ties and edges ------------------------------------------------------------------------------------------

#: What ``limitk`` and ``limit_ratio`` choose by, spelled as the engine spells a series.
_DIGEST = "md5('__name__' || chr(1) || 'event_value' || chr(2) || 'event_type' || chr(1) || event_type || chr(2) || 'shard' || chr(1) || shard || chr(2))"
register("limitk", f"limitk by (event_type) (3, {M})", ES, f"FINAL (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY {_DIGEST}) AS k FROM iv) WHERE k <= 3)")
register("limit_ratio", f"limit_ratio(0.3, {M})", ES, f"FINAL (SELECT * FROM iv WHERE substr({_DIGEST}, 1, 8) < '4ccccccd')")
register("limit_ratio_rest", f"limit_ratio(-0.7, {M})", ES, f"FINAL (SELECT * FROM iv WHERE substr({_DIGEST}, 1, 8) >= '4ccccccd')")
register("double_exponential_smoothing", f"double_exponential_smoothing({R}, 0.4, 0.3)", ES, None)
ORACLES["double_exponential_smoothing"] = (
    WITH.replace("WITH e AS", "WITH RECURSIVE e AS", 1)
    + """, n AS (SELECT event_type, shard, t, v, row_number() OVER (PARTITION BY event_type, shard, t ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type, shard, t) AS m FROM w),
m AS (SELECT a.event_type, a.shard, a.t, 1::BIGINT AS i, a.m, a.v AS s, b.v - a.v AS b FROM n a JOIN n b USING (event_type, shard, t) WHERE a.i = 1 AND b.i = 2
      UNION ALL
      SELECT n.event_type, n.shard, n.t, n.i, n.m, 0.4::DOUBLE * n.v + (1 - 0.4::DOUBLE) * (m.s + m.b),
             0.3::DOUBLE * (0.4::DOUBLE * n.v + (1 - 0.4::DOUBLE) * (m.s + m.b) - m.s) + (1 - 0.3::DOUBLE) * m.b
      FROM m JOIN n ON n.event_type = m.event_type AND n.shard = m.shard AND n.t = m.t AND n.i = m.i + 1)
SELECT event_type, shard, t, round(s, 6) + 0.0 AS v FROM m WHERE i = m.m"""
)
register("ts_of_min_over_time", f"ts_of_min_over_time({R})", ES, "FINAL (SELECT event_type, shard, t, max(ts) / 1e3 AS v FROM (SELECT w.*, min(v) OVER (PARTITION BY event_type, shard, t) AS low FROM w) WHERE v = low GROUP BY ALL)")
register("ts_of_first_over_time", f"ts_of_first_over_time({R})", ES, "FINAL (SELECT event_type, shard, t, t0 / 1e3 AS v FROM x)")
register("ts_of_last_over_time", f"ts_of_last_over_time({R})", ES, "FINAL (SELECT event_type, shard, t, t1 / 1e3 AS v FROM x)")
register("at_last_time", f"timestamp({M} @ {(START + 5 * DAY) // 1000})", ES, f"FINAL (SELECT iv.event_type, iv.shard, g.t, iv.ts / 1e3 AS v FROM iv, g WHERE iv.t = {START + 5 * DAY})")
register("predict_at", f"predict_linear({R} @ {(START + 5 * DAY) // 1000}, 3600)", ES, f"FINAL (SELECT k.event_type, k.shard, g.t, icpt + slope * 3600 AS v FROM k, g WHERE k.t = {START + 5 * DAY})")
register("literals", "vector(0x1F + 1e3 + .5 + 1h30m - -2 ^ 2)", (), "FINAL (SELECT t, 31 + 1000 + 0.5 + 5400 + 4 AS v FROM g)")
register("scalar_scalar", "vector((time() - 7) % 1000 / 2 > bool 100)", (), "FINAL (SELECT t, CASE WHEN (t // 1000 - 7) % 1000 / 2 > 100 THEN 1.0 ELSE 0.0 END AS v FROM g)")
register("round_to_zero", f"round({M}, 0)", ES, "FINAL (SELECT event_type, shard, t, 'nan'::DOUBLE AS v FROM iv)")
register("floor_large", f"floor({M} * 1e17) / 1e17 + ceil({M} * 1e17) / 1e17 + round({M} * 1e17) / 1e17", ES, "FINAL (SELECT event_type, shard, t, 3 * v AS v FROM iv)")
register("quantile_by_step", f"quantile by (event_type) (scalar(count({M})) / 100, {M})", E_, "FINAL (SELECT event_type, t, lo + (hi - lo) * (p - floor(p)) AS v FROM (SELECT event_type, t, p, list_sort(list(v))[CAST(floor(any_value(p)) AS INT) + 1] AS lo, list_sort(list(v))[CAST(ceil(any_value(p)) AS INT) + 1] AS hi FROM (SELECT *, (count(*) OVER (PARTITION BY event_type, t) - 1) * (count(*) OVER (PARTITION BY t) / 100.0) AS p FROM iv) GROUP BY event_type, t, p))")
register("topk_by_step", f"topk by (event_type) (scalar(count({M})) % 4 + 1, {M})", ES, "FINAL (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY v DESC, shard) AS k, count(*) OVER (PARTITION BY t) % 4 + 1 AS n FROM iv) WHERE k <= n)")
_SUMS = "(SELECT event_type, t, sum(v) AS s FROM iv GROUP BY ALL)"
register("group_right", f"sum by (event_type) ({M}) - on (event_type) group_right () {M}", ES, f"FINAL (SELECT iv.event_type, iv.shard, iv.t, s - v AS v FROM iv JOIN {_SUMS} USING (event_type, t))")
register("group_right_filter", f"sum by (event_type) ({M}) > on (event_type) group_right () ({M} * 5)", ES, f"FINAL (SELECT iv.event_type, iv.shard, iv.t, s AS v FROM iv JOIN {_SUMS} USING (event_type, t) WHERE s > v * 5)")
_KIND = f'label_replace(sum by (event_type) ({M}), "kind", "$1", "event_type", "(..).*")'
register("group_left_copied", f"{M} - on (event_type) group_left (kind) {_KIND}", (*ES, "kind"), f"FINAL (SELECT iv.event_type, iv.shard, left(iv.event_type, 2) AS kind, iv.t, v - s AS v FROM iv JOIN {_SUMS} USING (event_type, t))")
register("absent_short", f'absent({M}{{event_type="click", shard="3"}})', ES, "FINAL (SELECT 'click' AS event_type, '3' AS shard, t, 1.0 AS v FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.event_type = 'click' AND e.shard = '3' AND e.ts > g.t - 1200000 AND e.ts <= g.t))", lookback=1_200_000)
#: Steps much shorter than the window, and a window that steps do not divide.
for _key, _fn, _sql in (
    ("rate_fine_steps", f"sum by (event_type) (rate({M}[6h]))", f"FINAL (SELECT event_type, t, sum(v / {6 * 3600}e0) AS v FROM inc GROUP BY ALL)"),
    ("changes_fine_steps", f"changes({M}[6h])", "FINAL (SELECT event_type, shard, t, changes AS v FROM x)"),
    ("max_fine_steps", f"max_over_time({M}[6h])", "FINAL (SELECT event_type, shard, t, mx AS v FROM x)"),
):
    register(_key, _fn, E_ if "sum by" in _fn else ES, _sql, start=START + DAY, end=START + 4 * DAY, step=3_600_000)
    ORACLES[_key] = ORACLES[_key].replace(WITH, views(START + DAY, START + 4 * DAY, 3_600_000, 6 * 3_600_000))
register("sum_uneven_steps", f"sum_over_time({M}[10h])", ES, "FINAL (SELECT event_type, shard, t, s AS v FROM x)", start=START + DAY, end=START + 6 * DAY, step=25_200_000)
ORACLES["sum_uneven_steps"] = ORACLES["sum_uneven_steps"].replace(WITH, views(START + DAY, START + 6 * DAY, 25_200_000, 36_000_000))
register("grid_short_steps", M, ES, "FINAL iv", start=START + DAY, end=START + 3 * DAY, step=1_800_000, lookback=5 * 3_600_000)
ORACLES["grid_short_steps"] = ORACLES["grid_short_steps"].replace(WITH, views(START + DAY, START + 3 * DAY, 1_800_000, 5 * 3_600_000))


def _ranked(text: str):
    """The rows of a sorted instant query with their place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = engine(spark, sf_dir).query(text, START + 10 * DAY).withColumn("_at", F.monotonically_increasing_id())
        place = F.row_number().over(Window.orderBy("_at"))  # an instant's rows, one per series
        return project(rows.withColumn("place", place), ES, "place")

    return run


for _key, _fn, _by in (
    ("sort_order", f"sort({M})", "v, event_type, shard"),
    ("sort_desc_order", f"sort_desc({M})", "v DESC, event_type, shard"),
    ("sort_by_label_order", f'sort_by_label(label_replace({M}, "n", "x$1", "shard", "(.*)") * 1, "n", "event_type")', "CAST(shard AS INT), event_type"),
    ("sort_by_label_desc_order", f'sort_by_label_desc({M}, "event_type", "shard")', "event_type DESC, CAST(shard AS INT) DESC"),
):
    QUERIES[_key] = _ranked(_fn)
    ORACLES[_key] = WITH + f"SELECT event_type, shard, t, round(v, 6) + 0.0 AS v, row_number() OVER (ORDER BY {_by}) AS place FROM iv WHERE t = {START + 10 * DAY}"
