"""Query results against an evaluator over plain lists, at instants and over grids."""

import math
import random

import pytest
from dsl import same, vector
from reference import Store, delta, deviation, grouped, increase, irate, key, line, quantile, rate, rows_of, smooth

from tsq.plans.engine import Engine, QueryError
from tsq.sources.tables import scan_of

MINUTE = 60_000


def plant():
    """Pumps that count litres and are reset, tanks with levels that also fall, a valve that closes."""
    rng = random.Random(17)
    out = {}
    for site in ("north", "south"):
        for pump in ("1", "2", "10"):
            litres, points = 0.0, []
            for i in range(400):
                litres = 0.0 if rng.random() < 0.02 else litres + rng.choice([0, 1.5, 2, 7])
                if rng.random() > 0.1:
                    points.append((i * 15_000 + rng.randrange(900), litres))
            out["litres_total", ("site", site), ("pump", pump)] = points
        out["level", ("site", site)] = [(i * 60_000, 50 + 20 * math.sin(i / 7 + len(site)) - rng.randrange(3)) for i in range(100)]
    out["level_max", ("site", "north")] = [(i * 120_000, 80.0) for i in range(50)]
    out["valve", ("site", "north")] = [(i * 60_000, float(i)) for i in range(30)] + [(30 * 60_000, None)]
    out["odd", ("site", "north")] = [(i * 60_000, [1.0, float("nan"), -3.0, math.inf][i % 4]) for i in range(100)]
    return out


STORE = Store(plant())
AT = [31 * MINUTE + 1, 97 * MINUTE]


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(rows_of(STORE.series), "labels map<string,string>, t bigint, v double, stale boolean").repartition(3).cache()
    return Engine(spark, scan_of(df), default_step=MINUTE)


def over(fn, name="litres_total", width=5 * MINUTE, **labels):
    return lambda t: STORE.over(fn, name, t, width, **labels)


def values(fn):
    return lambda w, t, width: fn([v for _, v in w])


def pairs(test):
    return lambda w, t, width: float(sum(test(a, b) for (_, a), (_, b) in zip(w, w[1:], strict=False)))


def joined(a, b, fn):
    return {k: fn(a[k], b[k]) for k in a if k in b}


def named(name, found):
    return {tuple(sorted((*k, ("__name__", name)))): v for k, v in found.items()}


def now(name, t, **labels):
    return STORE.at(name, t, **labels)


CASES = {
    "rate(litres_total[5m])": over(rate),
    "increase(litres_total[17m])": over(increase, width=17 * MINUTE),
    "delta(level[20m])": over(delta, "level", 20 * MINUTE),
    "irate(litres_total[2m])": over(irate, width=2 * MINUTE),
    "idelta(level[20m])": over(lambda w, t, r: w[-1][1] - w[-2][1] if len(w) > 1 else None, "level", 20 * MINUTE),
    "deriv(level[20m])": over(lambda w, t, r: line(w, t, r)[0] if len(w) > 1 else None, "level", 20 * MINUTE),
    "predict_linear(level[20m], 600)": over(lambda w, t, r: line(w, t, r)[1] + 600 * line(w, t, r)[0] if len(w) > 1 else None, "level", 20 * MINUTE),
    "changes(litres_total[9m])": over(pairs(lambda a, b: a != b), width=9 * MINUTE),
    "resets(litres_total[40m])": over(pairs(lambda a, b: b < a), width=40 * MINUTE),
    "avg_over_time(level[10m])": over(values(lambda v: sum(v) / len(v)), "level", 10 * MINUTE),
    "min_over_time(level[10m])": over(values(min), "level", 10 * MINUTE),
    "max_over_time(level[10m])": over(values(max), "level", 10 * MINUTE),
    "sum_over_time(level[10m])": over(values(sum), "level", 10 * MINUTE),
    "count_over_time(litres_total[10m])": over(values(lambda v: float(len(v))), width=10 * MINUTE),
    "stddev_over_time(level[10m])": over(values(deviation), "level", 10 * MINUTE),
    "quantile_over_time(0.3, level[10m])": over(values(lambda v: quantile(0.3, v)), "level", 10 * MINUTE),
    "mad_over_time(level[10m])": over(values(lambda v: quantile(0.5, [abs(x - quantile(0.5, v)) for x in v])), "level", 10 * MINUTE),
    "double_exponential_smoothing(level[10m], 0.5, 0.25)": over(lambda w, t, r: smooth(w, 0.5, 0.25), "level", 10 * MINUTE),
    "last_over_time(level[10m])": lambda t: named("level", STORE.over(lambda w, t, r: w[-1][1], "level", t, 10 * MINUTE)),
    "first_over_time(level[10m])": lambda t: named("level", STORE.over(lambda w, t, r: w[0][1], "level", t, 10 * MINUTE)),
    "present_over_time(valve[10m])": over(values(lambda v: 1.0), "valve", 10 * MINUTE),
    "ts_of_max_over_time(level[10m])": over(lambda w, t, r: max((v, x) for x, v in w)[1] / 1000, "level", 10 * MINUTE),
    "ts_of_min_over_time(level[10m])": over(lambda w, t, r: min((v, -x) for x, v in w)[1] / -1000, "level", 10 * MINUTE),
    "ts_of_first_over_time(level[10m])": over(lambda w, t, r: w[0][0] / 1000, "level", 10 * MINUTE),
    "ts_of_last_over_time(level[10m])": over(lambda w, t, r: w[-1][0] / 1000, "level", 10 * MINUTE),
    "rate(litres_total[5m] offset 3m)": lambda t: STORE.over(rate, "litres_total", t - 3 * MINUTE, 5 * MINUTE),
    "rate(litres_total[5m] offset -3m)": lambda t: STORE.over(rate, "litres_total", t + 3 * MINUTE, 5 * MINUTE),
    "rate(litres_total[5m] @ 1800)": lambda t: STORE.over(rate, "litres_total", 1_800_000, 5 * MINUTE),
    'rate(litres_total{site=~"no.*", pump!="2"}[5m])': lambda t: {k: v for k, v in STORE.over(rate, "litres_total", t, 5 * MINUTE, site="north").items() if ("pump", "2") not in k},
    "sum by (site) (rate(litres_total[5m]))": lambda t: grouped(over(rate)(t), ("site",), sum),
    "avg without (pump) (rate(litres_total[5m]))": lambda t: grouped(over(rate)(t), ("site",), lambda v: sum(v) / len(v)),
    "max(litres_total)": lambda t: grouped(now("litres_total", t), (), max),
    "min by (pump) (litres_total)": lambda t: grouped(now("litres_total", t), ("pump",), min),
    "count(litres_total > 20)": lambda t: grouped({k: v for k, v in now("litres_total", t).items() if v > 20}, (), lambda v: float(len(v))),
    "group by (site) (litres_total)": lambda t: grouped(now("litres_total", t), ("site",), lambda v: 1.0),
    "stddev by (site) (litres_total)": lambda t: grouped(now("litres_total", t), ("site",), deviation),
    "quantile by (site) (0.6, litres_total)": lambda t: grouped(now("litres_total", t), ("site",), lambda v: quantile(0.6, v)),
    "quantile by (site) (scalar(count(level)) / 4, litres_total)": lambda t: grouped(now("litres_total", t), ("site",), lambda v: quantile(0.5, v)),
    "level": lambda t: named("level", now("level", t)),
    "valve": lambda t: named("valve", now("valve", t)),
    "level offset 90s": lambda t: named("level", now("level", t - 90_000)),
    "timestamp(level)": lambda t: {k: max(x for x, _ in p if x <= t) / 1000 for own, p in STORE.pick("level") for k in [key(**own)]},
    "level / on (site) level_max * 100": lambda t: joined(now("level", t), now("level_max", t), lambda a, b: a / b * 100),
    "litres_total / on (site) group_left () level": lambda t: {k: v / now("level", t)[tuple(x for x in k if x[0] == "site")] for k, v in now("litres_total", t).items()},
    "level and on (site) level_max": lambda t: named("level", {k: v for k, v in now("level", t).items() if k in now("level_max", t)}),
    "level unless on (site) valve": lambda t: named("level", {k: v for k, v in now("level", t).items() if k not in now("valve", t)}),
    "valve or on (site) level": lambda t: named("valve", now("valve", t)) | named("level", {k: v for k, v in now("level", t).items() if k not in now("valve", t)}),
    "absent(valve)": lambda t: {} if now("valve", t) else {(): 1.0},
    'absent(valve{site="south", kind=~"x.*"})': lambda t: {key(site="south"): 1.0},
    "absent_over_time(valve[3m])": lambda t: {} if STORE.windows("valve", t, 3 * MINUTE) else {(): 1.0},
    "max_over_time(sum(level)[12m:3m])": lambda t: {(): max(sums)} if (sums := [sum(now("level", x).values()) for x in range(-(-(t - 12 * MINUTE + 1) // (3 * MINUTE)) * 3 * MINUTE, t + 1, 3 * MINUTE) if now("level", x)]) else {},
    "level > bool 55": lambda t: {k: float(v > 55) for k, v in now("level", t).items()},
    "clamp(level, 45, 60)": lambda t: {k: min(max(v, 45), 60) for k, v in now("level", t).items()},
    "round(level, 5)": lambda t: {k: math.floor(v / 5 + 0.5) * 5 for k, v in now("level", t).items()},
    "floor(level * 1e20) + ceil(level * 1e20)": lambda t: {k: 2 * (v * 1e20) for k, v in now("level", t).items()},
    "round(level, 0)": lambda t: {k: math.nan for k in now("level", t)},
    "ln(level) + sqrt(level) - exp(level / 100)": lambda t: {k: math.log(v) + math.sqrt(v) - math.exp(v / 100) for k, v in now("level", t).items()},
    "floor(odd) + odd": lambda t: {k: v + (math.floor(v) if math.isfinite(v) else v) for k, v in now("odd", t).items()},
    "max_over_time(odd[4m])": over(values(lambda v: max(x for x in v if x == x)), "odd", 4 * MINUTE),
    "-level": lambda t: {k: -v for k, v in now("level", t).items()},
    "level * 0 + scalar(level_max)": lambda t: {k: now("level_max", t).get(key(site="north"), math.nan) for k in now("level", t)},
    'label_replace(level, "area", "a-$1", "site", "(.).*")': lambda t: named("level", {tuple(sorted((*k, ("area", "a-" + dict(k)["site"][0])))): v for k, v in now("level", t).items()}),
    'label_join(level, "both", "/", "site", "none", "site")': lambda t: named("level", {tuple(sorted((*k, ("both", f"{dict(k)['site']}//{dict(k)['site']}")))): v for k, v in now("level", t).items()}),
    'count_values("v", floor(level / 30))': lambda t: {key(v=str(x)): float(n) for x in range(5) if (n := sum(math.floor(v / 30) == x for v in now("level", t).values()))},
}


@pytest.mark.parametrize("text", CASES)
def test_instants(engine, text):
    for t in AT:
        got = vector(engine.query(text, t).collect())
        assert same(got, CASES[text](t)), (t, got, CASES[text](t))


GRIDS = (
    "rate(litres_total[5m])", "irate(litres_total[2m])", "changes(litres_total[9m])", "avg_over_time(level[10m])", "ts_of_min_over_time(level[10m])", "deriv(level[20m])",
    "last_over_time(level[10m])", "quantile_over_time(0.3, level[10m])", "absent_over_time(valve[3m])", "max_over_time(sum(level)[12m:3m])",
)


@pytest.mark.parametrize("step", [MINUTE // 4, 7 * MINUTE])
def test_grids(engine, step):
    """Every step of a grid is the instant's result, for steps under and over the windows and the lookback."""
    start = 20 * MINUTE + 1
    end = start + 60 * step
    for text in ("level", "valve", "litres_total offset 2m", "level @ 600", *GRIDS):
        by: dict = {}
        for r in engine.query_range(text, start, end, step).collect():
            by.setdefault(r["t"], []).append(r)
        want = CASES.get(text) or {"litres_total offset 2m": lambda t: named("litres_total", now("litres_total", t - 2 * MINUTE)), "level @ 600": lambda t: named("level", now("level", 600_000))}[text]
        for t in range(start, end + 1, step):
            assert same(vector(by.get(t, [])), want(t)), (text, t)


def test_top_and_order(engine):
    for t in AT:
        found = sorted(now("litres_total", t).values())
        assert sorted(r["v"] for r in engine.query("topk(3, litres_total)", t).collect()) == found[-3:]
        assert sorted(r["v"] for r in engine.query("bottomk(scalar(count(level)), litres_total)", t).collect()) == found[:2]
        assert [r["v"] for r in engine.query("sort_desc(litres_total)", t).collect()] == found[::-1]
        pumps = [r["labels"]["pump"] for r in engine.query('sort_by_label(litres_total, "pump")', t).collect()]
        assert pumps == ["1", "1", "2", "2", "10", "10"]
        assert len(engine.query("limitk(2, litres_total)", t).collect()) == 2
        some = {str(r["labels"]) for r in engine.query("limit_ratio(0.4, litres_total)", t).collect()}
        rest = {str(r["labels"]) for r in engine.query("limit_ratio(-0.6, litres_total)", t).collect()}
        assert not some & rest and len(some | rest) == 6


SCALARS = {
    "3 + 4 * 2": 11, "2 ^ 3 ^ 2": 512, "-3 ^ 2": -9, "17 % 5": 2, "-17 % 5": -2, "5 / 0": math.inf, "-5 / 0": -math.inf, "0 / 0": math.nan, "5 % 0": math.nan,
    "0xFf": 255, "1.5e3": 1500, ".25": 0.25, "7.": 7, "INF": math.inf, "nAn": math.nan, "2h5m": 7500, "4 >= bool 4": 1, "NaN == bool NaN": 0, "NaN != bool NaN": 1,
    "scalar(vector(8)) - 1": 7, "time()": 4321, "pi() * 2": 2 * math.pi, "scalar(level)": math.nan,
}


@pytest.mark.parametrize("text", SCALARS)
def test_scalars(engine, text):
    assert same(vector(engine.query(text, 4_321_000).collect()), {(): SCALARS[text]})


def test_clashes_and_guards(engine, spark):
    for text in ('label_replace(litres_total, "pump", "x", "", "")', 'abs({__name__=~"level|valve", site="north"})', "litres_total + on (site) litres_total"):
        with pytest.raises(Exception, match="labelset|duplicate series"):
            engine.query(text, 10 * MINUTE).collect()
    with pytest.raises(QueryError, match="steps"):
        engine.query_range("level", 0, 12_000, 1)
    rows = engine.query("litres_total", 10 * MINUTE)
    assert len(engine.collect(rows)) == 6
    with pytest.raises(QueryError, match="samples"):
        engine.collect(rows, most=5)


def test_two_samples_at_one_time(spark):
    """No rate between samples that have one time."""
    rows = [({"__name__": "m"}, t, v, False) for t, v in ((1000, 1.0), (60_000, 2.0), (60_000, 5.0))]
    e = Engine(spark, scan_of(spark.createDataFrame(rows, "labels map<string,string>, t bigint, v double, stale boolean")))
    assert e.query("irate(m[5m])", 61_000).collect() == []


def test_one_exchange_of_raw_samples(spark, engine):
    """A counter's samples are shuffled once, and what can be merged is reduced ahead of the shuffle."""
    def exchanges(text):
        plan = engine.query_range(text, 0, 60 * MINUTE, 10 * MINUTE)._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning"), plan

    n, _ = exchanges('increase(level{site="north"}[10m])')
    assert n == 1
    n, plan = exchanges("sum_over_time(level[10m])")
    assert n == 1 and "partial_sum" in plan
    n, plan = exchanges("level")
    assert n <= 2 and "partial_max_by" in plan
