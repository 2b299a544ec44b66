"""Lowering of a parsed query to a DataFrame plan, for one instant or a step grid.

Python runs at plan time only. A vector is ``(labels, t, v[, ts])``, and beside it ``(labels, t, h)`` where the samples hold
native histograms; a scalar is an expression of ``t`` where it can be, and else a frame ``(t, v)``, which has one row per
step. All row work is built-in expressions. Samples are reduced by (series, step) or (series, pane) ahead of a shuffle
wherever the function allows it, and a series is never the unit of work: a pane of it is.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsq.functions import instant
from tsq.functions.windows import KEEPS_NAME, MERGED, PAIRED, WHOLE
from tsq.model import NAME, NAN, arithmetic, compare, drop_name, key_of, label, lit_map, set_label
from tsq.operators.aggregate import aggregate, aggregate_by_parameter
from tsq.operators.binary import duplicates_fail, set_operation, vector_binary
from tsq.operators.histogram import HISTOGRAM, HISTOGRAM_CALLS, aggregate_histograms, histogram_quantile, histogram_windows
from tsq.promql.ast import Aggregate, Binary, Call, Matcher, Negate, Number, Selector, String, Subquery
from tsq.promql.parser import COMPARISONS, SETS, parse

LOOKBACK_MS = 300_000
MAX_STEPS = 11_000
INSTANT_PANES = 32


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.count).select((F.col("id") * self.step + self.start).alias("t"))


@dataclass
class Vector:
    """``df`` is ``(labels, t, v)``; ``ts`` tells whether the samples' own times are kept in a column of that name. ``hist`` is
    ``(labels, t, h)``, the histograms beside the floats, or null where there can be none."""

    df: DataFrame
    ts: bool = False
    order: list[Column] | None = None
    hist: DataFrame | None = None


@dataclass
class Scalar:
    """A value at every step: ``expr(t)``, or joined from ``df``."""

    expr: Callable[[Column], Column] | None = None
    df: DataFrame | None = None
    const: float | None = None

    @classmethod
    def of(cls, value: float) -> Scalar:
        return cls(expr=lambda t: F.lit(float(value)), const=float(value))


@dataclass
class Engine:
    """Evaluates queries over ``scan(matchers, low, high) -> (labels, t, v, stale[, h])``, samples with ``low < t <= high``.

    ``begin(start, end, step)``, if given, returns the scan for one request, for sources that depend on it.
    """

    spark: SparkSession
    scan: Callable[[tuple[Matcher, ...], int, int], DataFrame]
    lookback: int = LOOKBACK_MS
    default_step: int = 60_000
    max_steps: int = MAX_STEPS
    warnings: set[str] = field(default_factory=set)
    begin: Callable[[int, int, int], Callable] | None = None

    def query(self, text: str, at: int) -> DataFrame:
        """Instant query at ``at`` (ms)."""
        return self._run(text, Grid(at, at, 1))

    def query_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """Range query over ``start, start + step, ... <= end`` (ms)."""
        return self._run(text, self.grid(start, end, step))

    def histograms(self, text: str, start: int, end: int | None = None, step: int = 1) -> DataFrame:
        """``(labels, t, h)``: the native histograms of a query's result, at an instant or over a range."""
        out = self._bound(grid := self.grid(start, start if end is None else end, step)).eval(parse(text), grid)
        if not isinstance(out, Vector) or out.hist is None:
            return self.spark.createDataFrame([], f"labels map<string,string>, t bigint, h {HISTOGRAM}")
        return out.hist

    def grid(self, start: int, end: int, step: int) -> Grid:
        if step <= 0 or end < start:
            raise QueryError("bad range")
        grid = Grid(start, end, step)
        if grid.count > self.max_steps:
            raise QueryError(f"over {self.max_steps} steps")
        return grid

    def collect(self, df: DataFrame, most: int = 50_000_000, timeout_s: float = 120.0) -> list:
        """The rows of a result, with the guards of an interactive query: a row limit and a time limit."""
        context, group = self.spark.sparkContext, f"query-{id(df)}"
        late = threading.Event()

        def stop():
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(timeout_s, stop)
        context.setJobGroup(group, "query", interruptOnCancel=True)
        timer.start()
        try:
            rows = df.limit(most + 1).collect()
        except Exception as e:
            raise QueryError(f"over {timeout_s} s") from e if late.is_set() else e
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        if len(rows) > most:
            raise QueryError(f"over {most} samples")
        return rows

    def _bound(self, grid: Grid) -> Engine:
        """This engine with the scan for one request, and a memory of its subtrees, which are planned once."""
        scan = self.scan if self.begin is None else self.begin(grid.start, grid.end, grid.step)
        bound = replace(self, scan=scan, begin=None)
        bound.known = {}
        return bound

    def _run(self, text: str, grid: Grid) -> DataFrame:
        bound = self._bound(grid)
        out = bound.eval(parse(text), grid)
        if isinstance(out, str):
            raise QueryError("a text is not a result")
        if isinstance(out, Scalar):
            return bound.scalar_frame(out, grid).select(lit_map({}).alias("labels"), "t", "v")
        df = out.df.select("labels", "t", "v")
        return df.orderBy(*out.order) if out.order else df

    # -- nodes ---------------------------------------------------------------------------------------------------

    def eval(self, node, grid: Grid) -> Vector | Scalar | str:
        """Equal subtrees over equal steps are one plan, so their exchanges are reused."""
        known = getattr(self, "known", None)
        if known is None or not isinstance(node, Selector | Aggregate | Call | Binary):
            return self._eval(node, grid)
        if (node, grid) not in known:
            known[node, grid] = self._eval(node, grid)
        return known[node, grid]

    def _eval(self, node, grid: Grid) -> Vector | Scalar | str:
        if isinstance(node, Number):
            return Scalar.of(node.value)
        if isinstance(node, String):
            return node.value
        if isinstance(node, Selector):
            return self.instant_vector(node, grid)
        if isinstance(node, Negate):
            inner = self.eval(node.expr, grid)
            if isinstance(inner, Scalar):
                return self.map_scalar(inner, lambda v, t: -v)
            return Vector(inner.df.select(drop_name().alias("labels"), "t", (-F.col("v")).alias("v")))
        if isinstance(node, Aggregate):
            return self.aggregate(node, grid)
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        raise QueryError(f"{type(node).__name__} is not a value here")

    def at_time(self, node, grid: Grid) -> int | None:
        return {"start": grid.start, "end": grid.end}.get(node.at, node.at) if isinstance(node.at, str) else node.at

    def pinned(self, node, grid: Grid, build) -> DataFrame:
        """Evaluates a node under ``@`` once and repeats the result at every step."""
        at = self.at_time(node, grid)
        once = build(replace(node, at=None), Grid(at, at, 1))
        return once.drop("t").crossJoin(F.broadcast(grid.frame(self.spark)))  # one row per step, at most max_steps

    def instant_vector(self, node: Selector, grid: Grid) -> Vector:
        if node.at is not None:
            at = self.at_time(node, grid)
            once = self.instant_vector(replace(node, at=None), Grid(at, at, 1))
            steps = F.broadcast(grid.frame(self.spark))  # one row per step, at most max_steps
            hist = None if once.hist is None else once.hist.drop("t").crossJoin(steps).select("labels", "t", "h")
            return Vector(once.df.drop("t").crossJoin(steps).select("labels", "t", "v", "ts"), ts=True, hist=hist)
        first, last = grid.start - node.offset, grid.end - node.offset
        rows = self.scan(node.matchers, first - self.lookback, last)
        values = ["v", "h"] if "h" in rows.columns else ["v"]
        rows = rows.select(key_of().alias("key"), F.col("t").alias("ts"), *values, "stale")
        # the newest sample of every series and step, found ahead of the shuffle
        step = F.greatest(F.lit(0), F.ceil((F.col("ts") - first) / grid.step)).cast("long")
        newest = rows.withColumn("k", step).where(F.col("k") < grid.count)
        newest = newest.groupBy("key", "k").agg(F.max_by(F.struct(*values, "stale", "ts"), "ts").alias("x"))
        until = F.least(F.lit(grid.count - 1), F.ceil((F.col("x.ts") + self.lookback - first) / grid.step) - 1).cast("long")
        if self.lookback > grid.step and grid.count > 1:
            # a sample also stands for later steps, up to the next one's
            after = F.lead("k").over(Window.partitionBy("key").orderBy("k"))
            until = F.least(until, F.coalesce(after, F.lit(grid.count)) - 1)
        df = newest.withColumn("until", until).where((F.col("k") <= F.col("until")) & ~F.col("x.stale"))
        at = F.col("k") if self.lookback <= grid.step or grid.count == 1 else F.explode(F.sequence("k", "until"))
        df = df.select(F.map_from_entries("key").alias("labels"), at.alias("at"), *[F.col(f"x.{c}").alias(c) for c in (*values, "ts")])
        df = df.withColumn("t", F.col("at") * grid.step + grid.start)
        if "h" not in values:
            return Vector(df.select("labels", "t", "v", "ts"), ts=True)
        return Vector(df.where("h IS NULL").select("labels", "t", "v", "ts"), ts=True, hist=df.where("h IS NOT NULL").select("labels", "t", "h"))

    def samples(self, node, grid: Grid) -> DataFrame:
        """``(key, ts, v[, h])`` of all samples that a window over the grid can hold, at the times that count there."""
        first, last = grid.start - node.offset, grid.end - node.offset
        if isinstance(node, Selector):
            rows = self.scan(node.matchers, first - node.range, last).where(~F.col("stale"))
        else:
            step = node.step or self.default_step
            low = -(-(first - node.range + 1) // step) * step
            if low > last:
                rows = self.spark.createDataFrame([], "labels map<string,string>, t bigint, v double")
            else:
                rows = self.eval(node.expr, Grid(low, last - (last - low) % step, step)).df
        more = ["h"] if "h" in rows.columns else []
        return rows.select(key_of().alias("key"), (F.col("t") + node.offset).alias("ts"), "v", *more)

    def spread(self, rows: DataFrame, grid: Grid, low: Column, high: Column, range_ms: int) -> DataFrame:
        """Rows at every step whose window holds the times from ``low`` to ``high``; adds ``t`` and ``lo``."""
        if grid.count == 1:
            out = rows.withColumn("t", F.lit(grid.start).cast("long"))
        else:
            lo = F.greatest(F.lit(0), F.ceil((high - grid.start) / grid.step)).cast("long")
            hi = F.least(F.lit(grid.count - 1), F.ceil((low + range_ms - grid.start) / grid.step) - 1).cast("long")
            out = rows.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi")
            out = out.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("t", F.col("_k") * grid.step + grid.start).drop("_lo", "_hi", "_k")
        return out.withColumn("lo", F.col("t") - range_ms)

    def merged_window(self, name: str, rows: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
        """``(key, t, v)`` of a function whose panes can be merged."""
        fn, base = MERGED[name](), grid.start - range_ms
        # no window's edge falls inside a pane; an instant's one window has some, so that a series is many tasks' work
        width = math.gcd(range_ms, grid.step) if grid.count > 1 else -(-range_ms // INSTANT_PANES)
        rows = rows.withColumn("pane", F.ceil((F.col("ts") - base) / width).cast("long"))
        single = width == range_ms
        if name in PAIRED:
            placed = Window.partitionBy("key", "pane").orderBy("ts", "v")
            rows = rows.select("key", "pane", "ts", "v", F.lag(F.struct("ts", "v")).over(placed).alias("p"), F.row_number().over(placed).alias("i"))
            rows = rows.select("key", "pane", "ts", "v", "i", F.col("p.ts").alias("pts"), F.col("p.v").alias("pv"))
        panes = rows.groupBy("key", "pane").agg(*[c.alias(k) for k, c in fn.partial.items()])
        if name in PAIRED:
            none = F.lit(None).cast("struct<t1:bigint,v1:double>")
            p = none if single else F.lag(F.struct("t1", "v1")).over(Window.partitionBy("key").orderBy("pane"))
            panes = panes.withColumn("p", p).withColumn("pts", F.col("p.t1")).withColumn("pv", F.col("p.v1"))
        end = F.col("pane") * width + base
        panes = self.spread(panes, grid, end - width + 1, end, range_ms)
        # one pane a window needs no further shuffle
        keys = ["key", "pane", "t"] if single else ["key", "t"]
        out = panes.groupBy(*keys).agg(*[c.alias(k) for k, c in fn.final.items()])
        out = out if fn.test is None else out.where(fn.test)
        return out.select("key", "t", fn.result(range_ms).alias("v"))

    def window_call(self, name: str, node, grid: Grid, args: list) -> Vector:
        if node.at is not None:
            df = self.pinned(node, grid, lambda n, g: self.window_call(name, n, g, args).df)
            return Vector(df.select("labels", "t", "v"))
        rows, hist = self.samples(node, grid), None
        if "h" in rows.columns:
            if name in ("rate", "increase", "delta"):
                hist = histogram_windows(name, self.spread(rows.where("h IS NOT NULL").drop("v"), grid, F.col("ts"), F.col("ts"), node.range), node.range)
            rows = rows.where("h IS NULL").drop("h")
        if name in MERGED:
            df = self.merged_window(name, rows, grid, node.range)
        else:
            aggs, result, test = WHOLE[name](*args)
            grouped = self.spread(rows, grid, F.col("ts"), F.col("ts"), node.range).groupBy("key", "t").agg(*[a.alias(k) for k, a in aggs.items()])
            df = (grouped if test is None else grouped.where(test)).select("key", "t", result.alias("v"))
        out = Vector(df.select(F.map_from_entries("key").alias("labels"), "t", "v"), hist=hist)
        return out if name in KEEPS_NAME else self.nameless(out, node)

    def nameless(self, vector: Vector, source=None) -> Vector:
        """Drops the metric name; series of several names must stay distinct, which is checked where they may clash."""
        df = vector.df.withColumn("labels", drop_name())
        hist = None if vector.hist is None else vector.hist.withColumn("labels", drop_name())
        certain = isinstance(source, Selector) and source.name is not None or isinstance(source, Aggregate)
        return Vector(df if certain else duplicates_fail(df), hist=hist)

    # -- operators -----------------------------------------------------------------------------------------------

    def aggregate(self, node: Aggregate, grid: Grid) -> Vector:
        vector = self.eval(node.expr, grid)
        inner = vector.df.select("labels", "t", "v")
        param = None
        if node.param is not None:
            param = self.eval(node.param, grid)
            if isinstance(param, Scalar):
                if param.const is None:
                    if node.op not in ("topk", "bottomk", "quantile"):
                        raise QueryError(f"the parameter of {node.op} has to be a constant")
                    df, value = self.with_scalar(inner, param)
                    return Vector(aggregate_by_parameter(df.withColumn("_p", value), node.op, node.grouping, node.without))
                param = param.const
        hist = None
        if vector.hist is not None and node.op in ("sum", "avg"):
            hist = aggregate_histograms(vector.hist, node.op, node.grouping, node.without)
        return Vector(aggregate(inner, node.op, param, node.grouping, node.without), hist=hist)

    def binary(self, node: Binary, grid: Grid) -> Vector | Scalar:
        a, b = self.eval(node.left, grid), self.eval(node.right, grid)
        test = node.op in COMPARISONS
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            def both(x, y):
                return F.when(compare(node.op, x, y), 1.0).otherwise(0.0) if test else arithmetic(node.op, x, y)

            return self.join_scalars(a, b, both)
        if isinstance(a, Vector) and isinstance(b, Vector):
            if node.op in SETS:
                return Vector(set_operation(node.op, a.df.select("labels", "t", "v"), b.df.select("labels", "t", "v"), node.on, node.ignoring))
            return Vector(vector_binary(node, a.df.select("labels", "t", "v"), b.df.select("labels", "t", "v")))
        vector, scalar = (a, b) if isinstance(a, Vector) else (b, a)
        df, s = self.with_scalar(vector.df.select("labels", "t", "v"), scalar)
        x, y = (F.col("v"), s) if isinstance(a, Vector) else (s, F.col("v"))
        if test and not node.bool_:
            return Vector(df.where(compare(node.op, x, y)).select("labels", "t", "v"))
        out = F.when(compare(node.op, x, y), 1.0).otherwise(0.0) if test else arithmetic(node.op, x, y)
        return self.nameless(Vector(df.select("labels", "t", out.alias("v"))), node.left if isinstance(a, Vector) else node.right)

    def with_scalar(self, df: DataFrame, scalar: Scalar) -> tuple[DataFrame, Column]:
        if scalar.expr is not None:
            return df, scalar.expr(F.col("t"))
        # one row per step, at most max_steps
        return df.join(F.broadcast(scalar.df.select("t", F.col("v").alias("_s"))), "t"), F.col("_s")

    def scalar_frame(self, scalar: Scalar, grid: Grid) -> DataFrame:
        if scalar.df is not None:
            return scalar.df
        return grid.frame(self.spark).withColumn("v", scalar.expr(F.col("t")))

    def map_scalar(self, scalar: Scalar, fn) -> Scalar:
        if scalar.expr is not None:
            const = None
            if scalar.const is not None:
                row = self.spark.range(1).select(fn(F.lit(scalar.const), F.lit(0).cast("long")).alias("v")).first()
                const = row["v"]
            return Scalar(expr=lambda t: fn(scalar.expr(t), t), const=const)
        return Scalar(df=scalar.df.select("t", fn(F.col("v"), F.col("t")).alias("v")))

    def join_scalars(self, a: Scalar, b: Scalar, fn) -> Scalar:
        if a.expr is not None and b.expr is not None:
            const = None
            if a.const is not None and b.const is not None:
                const = self.spark.range(1).select(fn(F.lit(a.const), F.lit(b.const)).alias("v")).first()["v"]
            return Scalar(expr=lambda t: fn(a.expr(t), b.expr(t)), const=const)
        if a.df is not None and b.df is not None:
            df = a.df.join(b.df.select("t", F.col("v").alias("w")), "t").select("t", fn(F.col("v"), F.col("w")).alias("v"))
            return Scalar(df=df)
        if a.df is not None:
            return Scalar(df=a.df.select("t", fn(F.col("v"), b.expr(F.col("t"))).alias("v")))
        return Scalar(df=b.df.select("t", fn(a.expr(F.col("t")), F.col("v")).alias("v")))

    # -- functions -----------------------------------------------------------------------------------------------

    def const(self, node, grid: Grid, what: str) -> float:
        s = self.eval(node, grid)
        if not isinstance(s, Scalar) or s.const is None:
            raise QueryError(f"{what} has to be a constant")
        return s.const

    def call(self, node: Call, grid: Grid) -> Vector | Scalar:
        name, args = node.name, node.args
        if name == "time":
            return Scalar(expr=lambda t: t / F.lit(1000.0))
        if name == "pi":
            return Scalar.of(math.pi)
        if name == "vector":
            s = self.scalar_frame(self.eval(args[0], grid), grid)
            return Vector(s.select(lit_map({}).alias("labels"), "t", "v"))
        if name == "scalar":
            inner = self.eval(args[0], grid).df
            one = inner.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("x"))
            one = one.select("t", F.when(F.col("n") == 1, F.col("x")).otherwise(F.lit(NAN)).alias("v"))
            return Scalar(df=grid.frame(self.spark).join(one, "t", "left").select("t", F.coalesce("v", F.lit(NAN)).alias("v")))
        if name == "absent_over_time":
            present = self.window_call("present_over_time", args[0], grid, []).df
            return self.absent(args[0], present, grid)
        if name == "absent":
            return self.absent(args[0], self.eval(args[0], grid).df, grid)
        if name in MERGED or name in WHOLE:
            window = next(a for a in args if isinstance(a, Selector | Subquery) and getattr(a, "range", None) is not None)
            rest = [self.const(a, grid, f"an argument of {name}") for a in args if a is not window]
            if name in ("double_exponential_smoothing", "holt_winters") and not all(0 < x < 1 for x in rest):
                raise QueryError("smoothing factors lie between 0 and 1")
            return self.window_call(name, window, grid, rest)
        if name in instant.DATES:
            if not args:
                v = grid.frame(self.spark).select(lit_map({}).alias("labels"), "t", (F.col("t") / 1000.0).alias("v"))
            else:
                v = self.eval(args[0], grid).df
            out = v.select("labels", "t", instant.DATES[name](F.col("v")).alias("v"))
            return self.nameless(Vector(out), args[0] if args else None) if args else Vector(out)
        if name in ("sort", "sort_desc", "sort_by_label", "sort_by_label_desc"):
            return self.sort(name, args, grid)
        if name in ("label_replace", "label_join"):
            return self.relabel(name, args, grid)
        if name in HISTOGRAM_CALLS:
            numbers = [self.const(a, grid, f"an argument of {name}") for a in args[:-1]]
            inner = self.eval(args[-1], grid)
            empty = inner.df.select("labels", "t", "v").where("false")
            df = histogram_quantile(numbers[0], inner.df.select("labels", "t", "v")) if name == "histogram_quantile" else empty
            if inner.hist is not None:
                native = inner.hist.select(drop_name().alias("labels"), "t", HISTOGRAM_CALLS[name](*numbers).alias("v"))
                df = native if name != "histogram_quantile" else df.unionByName(native)
            return Vector(df)
        if name == "info":
            return self.info(args, grid)
        inner = self.eval(args[0], grid)
        if name == "timestamp":
            v = F.col("ts") if inner.ts else F.col("t")
            return self.nameless(Vector(inner.df.select("labels", "t", (v / 1000.0).alias("v"))), args[0])
        df, extra = inner.df.select("labels", "t", "v"), []
        for a in args[1:]:
            s = self.eval(a, grid)
            if s.expr is not None:
                extra.append(s.expr(F.col("t")))
            else:
                at = f"_s{len(extra)}"
                df = df.join(F.broadcast(s.df.select("t", F.col("v").alias(at))), "t")  # one row per step
                extra.append(F.col(at))
        v = F.col("v")
        if name in instant.MATH:
            out = instant.MATH[name](v)
        elif name == "round":
            out = instant.round_to(v, extra[0] if extra else F.lit(1.0))
        elif name == "clamp_min":
            out = instant.clamp_min(v, extra[0])
        elif name == "clamp_max":
            out = instant.clamp_max(v, extra[0])
        elif name == "clamp":
            df = df.where(~(extra[0] > extra[1]))
            out = instant.clamp_max(instant.clamp_min(v, extra[0]), extra[1])
        else:
            raise QueryError(f"{name} is not available")
        return self.nameless(Vector(df.select("labels", "t", out.alias("v"))), args[0])

    def absent(self, source, present: DataFrame, grid: Grid) -> Vector:
        """1 at every step without a sample, labelled by the selector's equality matchers that occur once."""
        names = [m.name for m in source.matchers] if isinstance(source, Selector) else []
        known = {m.name: m.value for m in getattr(source, "matchers", ()) if m.op == "=" and m.name != NAME and m.value and names.count(m.name) == 1}
        steps = grid.frame(self.spark).join(present.select("t").distinct(), "t", "left_anti")
        return Vector(steps.select(lit_map(known).alias("labels"), "t", F.lit(1.0).alias("v")))

    def sort(self, name: str, args, grid: Grid) -> Vector:
        inner = self.eval(args[0], grid)
        if grid.count > 1:
            return inner
        if "label" in name:
            keys = [natural(label(a.value)) for a in args[1:]]
            order = [k.desc() if name.endswith("desc") else k.asc() for k in keys]
        else:
            v = F.col("v")
            order = [F.isnan(v), v.desc() if name == "sort_desc" else v.asc()]
        return Vector(inner.df, order=[*order, key_of()])

    def relabel(self, name: str, args, grid: Grid) -> Vector:
        df = self.eval(args[0], grid).df.select("labels", "t", "v")
        text = [a.value for a in args[1:]]
        if name == "label_join":
            value = F.concat_ws(text[1], *[label(x) for x in text[2:]])
            return Vector(duplicates_fail(df.withColumn("labels", set_label(F.col("labels"), text[0], value))))
        target, put, source, pattern = text
        anchored = f"(?s)^(?:{pattern})$"
        value = F.regexp_replace(label(source), anchored, java_replacement(put))
        new = F.when(label(source).rlike(anchored), set_label(F.col("labels"), target, value)).otherwise(F.col("labels"))
        return Vector(duplicates_fail(df.withColumn("labels", new)))

    def info(self, args, grid: Grid) -> Vector:
        """Adds the labels of info series that share ``job`` and ``instance``; ``target_info`` unless a selector names others."""
        df = self.eval(args[0], grid).df.select("labels", "t", "v")
        chosen = args[1].matchers if len(args) > 1 else ()
        if not any(m.name == NAME for m in chosen):
            chosen = (Matcher(NAME, "=", "target_info"), *chosen)
        side = self.instant_vector(Selector(tuple(chosen)), grid).df
        asked = [m.name for m in chosen if m.name != NAME]
        more = F.map_filter("labels", lambda k, _: ~k.isin(NAME, "job", "instance") & (k.isin(asked) if asked else F.lit(True)))
        side = side.select(label("job").alias("_j"), label("instance").alias("_i"), "t", more.alias("_more"))
        joined = df.withColumn("_j", label("job")).withColumn("_i", label("instance")).join(side, ["_j", "_i", "t"], "left")
        fresh = F.map_filter("_more", lambda k, _: ~F.map_contains_key("labels", k))
        return Vector(joined.select(F.when(F.col("_more").isNull(), F.col("labels")).otherwise(F.map_concat("labels", fresh)).alias("labels"), "t", "v"))


def natural(text: Column) -> Column:
    """A sort key by which runs of digits compare as numbers: each is led by its length without zeros in front."""
    parts = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda p: F.ltrim(p, F.lit("0"))
    spelled = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))).otherwise(p))
    return F.struct(F.array_join(spelled, ""), text)


def java_replacement(text: str) -> str:
    """``$1``, ``${1}`` and ``${name}`` as Java spells them, all else literal."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "$":
            rest = text[i + 1 :]
            if rest.startswith("$"):
                out.append("\\$")
                i += 2
                continue
            name = ""
            if rest.startswith("{") and "}" in rest:
                name = rest[1 : rest.index("}")]
                i += len(name) + 3
            else:
                while len(name) < len(rest) and (rest[len(name)].isalnum() or rest[len(name)] == "_"):
                    name += rest[len(name)]
                i += 1 + len(name)
            out.append(f"${name}" if name.isdigit() else "${" + name + "}" if name else "\\$")
            continue
        out.append("\\" + c if c == "\\" else c)
        i += 1
    return "".join(out)

