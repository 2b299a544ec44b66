"""Sources: one contract of eight calls, and the wrappers that prune, scope, relabel and shift what a source gives.

A :class:`Source` is one table of samples with its rewrites, a :class:`Group` replicas of the same data, a
:class:`Federation` groups as shards of one store. All three answer ``query``, ``query_range``, ``get_value``, ``series``,
``label_names``, ``label_values``, ``metadata`` and ``exemplars``. Time bounds and every matcher that no rewrite touches
are predicates of the table below, so they reach its reader.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq import catalog
from tsq.model import NAME, key_of, label, match, set_label, with_labels
from tsq.operators.merge import merge_replicas
from tsq.promql.ast import Matcher
from tsq.promql.parser import parse, parse_selector, selectors, selects

log = logging.getLogger(__name__)
Scan = Callable[[tuple[Matcher, ...], int, int], DataFrame]
Request = tuple[int, int, int]
EVER = 2**53
EMPTY = "labels map<string,string>, t bigint, v double, stale boolean"


@dataclass(frozen=True)
class Relabel:
    """``replace`` (whole value into ``target``), ``labeldrop`` (``source`` is a pattern), ``lowercase`` or ``uppercase``."""

    action: str
    source: str
    target: str = ""

    def __post_init__(self):
        if self.action not in ("replace", "labeldrop", "lowercase", "uppercase"):
            raise ValueError(f"unsupported action {self.action}")
        if not self.source:
            raise ValueError("a source label or pattern is needed")
        if self.action == "replace" and not self.target:
            raise ValueError("replace needs a target")
        if self.action == "labeldrop" and self.target:
            raise ValueError("labeldrop takes no target")
        if "$" in self.target:
            raise ValueError("no templates in a target")

    def touches(self, name: str) -> bool:
        """Whether the label's value can differ after this step."""
        if self.action == "labeldrop":
            return re.fullmatch(self.source, name, re.S) is not None
        return name == (self.target or self.source)

    def apply(self, labels: Column) -> Column:
        if self.action == "labeldrop":
            return F.map_filter(labels, lambda k, _: ~k.rlike(f"(?s)^(?:{self.source})$"))
        value = label(self.source, labels)
        value = {"replace": lambda v: v, "lowercase": F.lower, "uppercase": F.upper}[self.action](value)
        new = set_label(labels, self.target or self.source, value)
        return F.when(value == "", labels).otherwise(new) if self.action == "replace" else new


@dataclass(frozen=True)
class LabelFilter:
    """The values a source is known to have by label; ``fixed`` values are added and ``excluded`` ones taken away."""

    values: Mapping[str, frozenset[str]]

    @classmethod
    def collect(cls, df: DataFrame, names: list[str], fixed: Mapping[str, set] | None = None, excluded: Mapping[str, set] | None = None, most: int = 100_000) -> LabelFilter:
        """Reads at most ``most`` values of each label; a label with more is not filtered on."""
        out = {}
        for n in names:
            found = [r["x"] for r in df.select(label(n).alias("x")).where("x <> ''").distinct().limit(most + 1).collect()]
            if len(found) <= most:
                out[n] = frozenset(({*found} | set((fixed or {}).get(n, ()))) - set((excluded or {}).get(n, ())))
        return cls(out)

    def admits(self, matchers) -> bool:
        return all(any(holds(m, v) for v in self.values[m.name]) for m in matchers if m.name in self.values)


class RefreshedFilter:
    """A label filter that is collected anew when it is asked for and ``every_ms`` have passed since the last time."""

    def __init__(self, collect: Callable[[], LabelFilter], every_ms: int, clock: Callable[[], int]):
        self.collect, self.every_ms, self.clock = collect, every_ms, clock
        self.held: LabelFilter | None = None
        self.since = 0

    def admits(self, matchers) -> bool:
        now = self.clock()
        if self.held is None or now - self.since >= self.every_ms:
            self.held, self.since = self.collect(), now
        return self.held.admits(matchers)


def holds(m: Matcher, value: str) -> bool:
    hit = value == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, value, re.S) is not None
    return hit == (m.op in ("=", "=~"))


@dataclass(frozen=True)
class TimeBounds:
    """Inclusive bounds in ms; ``relative`` ones are added to the time of the query. Null is unbounded."""

    start: int | None = None
    end: int | None = None
    relative: bool = False
    truncate: bool = False

    def at(self, now: int) -> tuple[int | None, int | None]:
        shift = now if self.relative else 0
        return (None if self.start is None else self.start + shift), (None if self.end is None else self.end + shift)

    def overlaps(self, low: int, high: int, now: int = 0) -> bool:
        a, b = self.at(now)
        return (a is None or high >= a) and (b is None or low <= b)

    def clip(self, start: int, end: int, step: int, now: int = 0) -> tuple[int, int] | None:
        """A request's range inside the bounds; a start that moves stays on the request's grid."""
        if not self.overlaps(start, end, now):
            return None
        if not self.truncate:
            return start, end
        a, b = self.at(now)
        if a is not None and start < a:
            start += -(-(a - start) // step) * step
        end = end if b is None else min(end, b)
        return (start, end) if start <= end else None


def step_align(df: DataFrame, start: int, step: int) -> DataFrame:
    """Shifts the times of a source that snaps to multiples of the step forward onto the request's grid."""
    return df.withColumn("t", F.col("t") + start % step)


class SourceError(RuntimeError):
    pass


class Api:
    """The eight calls, over ``scan`` and ``parts``: the frames of a scan before any merge."""

    now = 0

    def session(self) -> SparkSession:
        raise NotImplementedError

    def scan(self, matchers, low: int, high: int, now: int | None = None, request: Request | None = None) -> DataFrame | None:
        raise NotImplementedError

    def parts(self, matchers, low: int, high: int, now: int | None = None) -> list[DataFrame]:
        raise NotImplementedError

    def get_value(self, matchers, low: int, high: int) -> DataFrame:
        """Raw samples ``low < t <= high``, stale marks and histograms among them."""
        found = self.scan(tuple(matchers), low, high)
        return found if found is not None else self.session().createDataFrame([], EMPTY)

    def engine(self, **options):
        """An engine over this source."""
        from tsq.plans.engine import Engine

        return Engine(self.session(), self.get_value, begin=self.begin, **options)

    def begin(self, start: int, end: int, step: int) -> Scan:
        """The scan for one request: shifts and relative bounds depend on it."""

        def scan(matchers, low, high):
            found = self.scan(tuple(matchers), low, high, request=(start, end, step))
            return found if found is not None else self.session().createDataFrame([], EMPTY)

        return scan

    def query(self, text: str, at: int, **options) -> DataFrame:
        return self.engine(**options).query(text, at)

    def query_range(self, text: str, start: int, end: int, step: int, **options) -> DataFrame:
        return self.engine(**options).query_range(text, start, end, step)

    def _labels(self, match_texts, start: int | None, end: int | None) -> DataFrame:
        """Labels of the samples that any selector picks, with repeats; each source reads its own bounds only."""
        chosen = [parse_selector(m).matchers for m in match_texts] or [()]
        low, high = (-EVER if start is None else start) - 1, EVER if end is None else end
        found = [d.select("labels") for m in chosen for d in self.parts(m, low, high)]
        return reduce(DataFrame.unionByName, found) if found else self.session().createDataFrame([], "labels map<string,string>")

    def series(self, match_texts, start: int | None = None, end: int | None = None) -> DataFrame:
        return catalog.series(self._labels(match_texts, start, end), ())

    def label_names(self, match_texts=(), start: int | None = None, end: int | None = None) -> DataFrame:
        return catalog.label_names(self._labels(match_texts, start, end))

    def label_values(self, name: str, match_texts=(), start: int | None = None, end: int | None = None) -> DataFrame:
        return catalog.label_values(self._labels(match_texts, start, end), name)

    def metadata_tables(self, metric: str) -> list[DataFrame]:
        raise NotImplementedError

    def metadata(self, metric: str = "", limit: int | None = None) -> DataFrame:
        found = self.metadata_tables(metric)
        none = self.session().createDataFrame([], "metric string, type string, help string, unit string")
        return catalog.metadata(found or [none], metric, limit)

    def exemplar_tables(self, text: str, start: int, end: int) -> list[DataFrame]:
        raise NotImplementedError

    def exemplars(self, text: str, start: int, end: int) -> DataFrame:
        found = self.exemplar_tables(text, start, end)
        none = self.session().createDataFrame([], "labels map<string,string>, ex_labels map<string,string>, v double, t bigint")
        return catalog.exemplars(found or [none], text, start, end)


@dataclass(frozen=True)
class Source(Api):
    """Samples ``(labels, t, v, stale[, h])`` and their rewrites, applied in a fixed order: time bounds, step alignment,
    injected matchers, added labels, relabelling, label filter.

    ``samples`` is a frame or a scan, which a table catalog or another store's ``get_value`` gives. Series that a
    relabelling step makes one are merged: where several meet at one time, or a label was dropped, the largest value stays.
    Samples that the table itself has at one time of one series all stay, as they do without relabelling.
    """

    samples: DataFrame | Scan
    name: str = ""
    labels: Mapping[str, str] = field(default_factory=dict)
    inject: tuple[Matcher, ...] = ()
    relabel: tuple[Relabel, ...] = ()
    bounds: tuple[TimeBounds, ...] = ()
    label_filter: LabelFilter | RefreshedFilter | None = None
    align: bool = False
    optional: bool = False
    warn_only: bool = False
    probe: bool = False
    metadata_table: DataFrame | None = None
    exemplar_table: DataFrame | None = None
    spark: SparkSession | None = None

    def session(self) -> SparkSession:
        if self.spark is not None:
            return self.spark
        return self.samples.sparkSession if isinstance(self.samples, DataFrame) else SparkSession.active()

    def known(self, name: str) -> str | None:
        """A label's value in every series of this source, where the rewrites decide it; else null."""
        values: dict[str, str | None] = dict(self.labels)
        for r in self.relabel:
            if r.action == "labeldrop":
                values = {k: "" if r.touches(k) else v for k, v in values.items()}
                if name not in values and r.touches(name):
                    values[name] = ""
                continue
            own = values.get(r.source)
            target = r.target or r.source
            if own is None:
                if target in values or target == name:
                    values[target] = None
            elif r.action != "replace":
                values[target] = own.lower() if r.action == "lowercase" else own.upper()
            elif own:
                values[target] = own
        return values.get(name)

    def prune(self, matchers, low: int, high: int, now: int = 0) -> tuple[Matcher, ...] | None:
        """The matchers left after those on decided labels, or null where the source cannot answer."""
        if not all(b.overlaps(low + 1, high, now) for b in self.bounds):
            return None
        if self.label_filter is not None and not self.label_filter.admits(matchers):
            return None
        left = []
        for m in matchers:
            value = self.known(m.name)
            if value is None:
                left.append(m)
            elif not holds(m, value):
                return None
        return tuple(left)

    def below(self, matchers) -> tuple[Matcher, ...]:
        """The matchers that mean the same ahead of the rewrites, which the table itself can take."""
        return tuple(m for m in matchers if m.name not in self.labels and not any(r.touches(m.name) for r in self.relabel))

    def _read(self, matchers, low: int, high: int) -> DataFrame:
        if not isinstance(self.samples, DataFrame):
            return self.samples(tuple(matchers), low, high)
        cond = match(matchers)
        if low > -EVER:
            cond = (F.col("t") > low) & cond
        if high < EVER:
            cond = (F.col("t") <= high) & cond
        return self.samples.where(cond)

    def _lost(self) -> Column:
        """Whether a ``labeldrop`` takes a label of the table's own from the series."""
        drops = [r.source for r in self.relabel if r.action == "labeldrop"]
        return F.exists(F.map_keys("labels"), lambda k: reduce(lambda a, b: a | b, [k.rlike(f"(?s)^(?:{d})$") for d in drops])) if drops else F.lit(False)

    def _origin(self) -> Column:
        """What the labels written over were in the table: with the new labels it tells apart the series that lost none."""
        written = {*self.labels, *[r.target or r.source for r in self.relabel if r.action != "labeldrop"]}
        return F.array(F.lit(""), *[label(k) for k in sorted(written)])

    def _met(self, df: DataFrame, values: list[str]) -> DataFrame:
        """Of samples that relabelling brings under one label set and time the largest; all, where one series has them all."""
        best = F.struct(~F.col("stale"), F.coalesce("v", F.lit(float("-inf"))))
        one, whole = F.struct(*values), ~F.col("lost")
        aggs = [F.max_by(one, best).alias("top"), F.collect_list(F.when(whole, one)).alias("own"), (F.max("lost") | (F.min("origin") != F.max("origin"))).alias("several")]
        df = df.groupBy(key_of().alias("key"), "t").agg(*aggs)
        df = df.select("key", "t", F.explode(F.when(F.col("several"), F.array("top")).otherwise(F.col("own"))).alias("x"))
        return df.select(F.map_from_entries("key").alias("labels"), "t", *[f"x.{c}" for c in values])

    def scan(self, matchers, low: int, high: int, now: int | None = None, request: Request | None = None) -> DataFrame | None:
        now = (request[1] if request else self.now) if now is None else now
        left = self.prune(matchers, low, high, now)
        if left is None:
            return None
        for b in self.bounds:
            if b.truncate:
                x, y = b.at(now)
                low, high = low if x is None else max(low, x - 1), high if y is None else min(high, y)
        shift = request[0] % request[2] if self.align and request else 0
        df = self._read((*self.inject, *self.below(left)), low - shift, high - shift)
        values = ["v", "stale", "h"] if "h" in df.columns else ["v", "stale"]
        labels = with_labels(F.col("labels"), self.labels)
        for r in self.relabel:
            labels = r.apply(labels)
        df = df.select(labels.alias("labels"), (F.col("t") + shift).alias("t"), *values, self._lost().alias("lost"), self._origin().alias("origin")).where(match(left))
        df = self._met(df, values) if self.relabel else df.drop("lost", "origin")
        if self.probe:
            df.limit(1).count()  # a table that cannot be read fails here, where the group's policy sees it
        return df

    def parts(self, matchers, low: int, high: int, now: int | None = None) -> list[DataFrame]:
        found = self.scan(tuple(matchers), low, high, now)
        return [] if found is None else [found]

    def query(self, text: str, at: int, now: int | None = None, **options) -> DataFrame:
        now = at if now is None else now
        if not all(b.overlaps(at, at, now) for b in self.bounds):
            return self.session().createDataFrame([], "labels map<string,string>, t bigint, v double")
        return self.engine(**options).query(text, at)

    def query_range(self, text: str, start: int, end: int, step: int, now: int | None = None, **options) -> DataFrame:
        """Over the steps inside the bounds; a moved start stays on the request's grid."""
        now = end if now is None else now
        for b in self.bounds:
            inside = b.clip(start, end, step, now)
            if inside is None:
                return self.session().createDataFrame([], "labels map<string,string>, t bigint, v double")
            start, end = inside
        return self.engine(**options).query_range(text, start, end, step)

    def metadata_tables(self, metric: str) -> list[DataFrame]:
        """An empty name stands for all metrics and passes every filter."""
        admitted = not metric or self.label_filter is None or self.label_filter.admits((Matcher(NAME, "=", metric),))
        return [self.metadata_table] if self.metadata_table is not None and admitted else []

    def exemplar_tables(self, text: str, start: int, end: int) -> list[DataFrame]:
        if self.exemplar_table is None or not any(self.prune(s.matchers, start - 1, end) is not None for s in selectors(parse(text))):
            return []
        labels = with_labels(F.col("labels"), self.labels)
        for r in self.relabel:
            labels = r.apply(labels)
        df = self.exemplar_table.where(match(self.inject))
        for b in self.bounds:
            x, y = b.at(self.now)
            df = df if x is None or not b.truncate else df.where(F.col("t") >= x)
            df = df if y is None or not b.truncate else df.where(F.col("t") <= y)
        return [df.withColumn("labels", labels)]


@dataclass
class EngineSource:
    """An engine as a source of query results; it has no raw samples, so the other calls are refused."""

    inner: object

    def query(self, text: str, at: int) -> DataFrame:
        return self.inner.query(text, at)

    def query_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        return self.inner.query_range(text, start, end, step)

    def __getattr__(self, name: str):
        if name in ("get_value", "series", "label_names", "label_values", "metadata", "exemplars"):
            raise NotImplementedError(f"an engine does not answer {name}")
        raise AttributeError(name)


def inject_matchers(matchers: tuple[Matcher, ...], extra: tuple[Matcher, ...]) -> tuple[Matcher, ...]:
    """Appends the matchers that are not there yet."""
    return (*matchers, *(m for m in extra if m not in matchers))


def strip_added(matchers: tuple[Matcher, ...], added: Mapping[str, str]) -> tuple[Matcher, ...] | None:
    """Decides matchers on added labels; a selector left with nothing selects every series."""
    if not all(holds(m, added[m.name]) for m in matchers if m.name in added):
        return None
    left = tuple(m for m in matchers if m.name not in added)
    return left if any(selects(m) for m in left) else (*left, Matcher(NAME, "=~", ".+"))


@dataclass
class Group(Api):
    """Replicas of the same data: merged with a buffer; one that answers is enough for each set of added labels.

    Errors count when a replica is asked: a table that is opened by a scan fails then, and with ``probe`` so does one whose
    first row cannot be read. An error that the quorum or a replica's policy covers becomes a warning.
    """

    replicas: list[Source]
    buffer_ms: int = 10_000
    dynamic: bool = False
    prefer_max: bool = False
    quorum: int = 1
    warnings: set[str] = field(default_factory=set)

    def session(self) -> SparkSession:
        return self.replicas[0].session()

    def gather(self, call: Callable[[Source], object]) -> list:
        """What the replicas answer, in order; fails where too few of a set of added labels do."""
        found, answered, wanted = [], {}, {}
        for r in self.replicas:
            bucket = tuple(sorted(r.labels.items()))
            wanted[bucket] = wanted.get(bucket, 0) + 1
            answered.setdefault(bucket, 0)
            try:
                found.append(call(r))
                answered[bucket] += 1
            except Exception as e:
                text = f"{r.name or 'source'}: {e}".splitlines()[0]
                if r.optional:
                    log.info("ignored: %s", text)
                else:
                    self.warnings.add(text)
                    log.warning("%s", text)
                if r.optional or r.warn_only:
                    answered[bucket] += 1
        if any(n < min(self.quorum, wanted[b]) for b, n in answered.items()):
            raise SourceError("too few replicas answered")
        return found

    def scan(self, matchers, low: int, high: int, now: int | None = None, request: Request | None = None) -> DataFrame | None:
        found = [d for d in self.gather(lambda r: r.scan(matchers, low, high, now, request)) if d is not None]
        how = {"dynamic": self.dynamic, "prefer_max": self.prefer_max}
        return _merge(found, lambda sides, value: merge_replicas(sides, self.buffer_ms, value=value, **(how if value == "v" else {"dynamic": self.dynamic})))

    def parts(self, matchers, low: int, high: int, now: int | None = None) -> list[DataFrame]:
        return [d for part in self.gather(lambda r: r.parts(matchers, low, high, now)) for d in part]

    def metadata_tables(self, metric: str) -> list[DataFrame]:
        return [d for part in self.gather(lambda r: r.metadata_tables(metric)) for d in part]

    def exemplar_tables(self, text: str, start: int, end: int) -> list[DataFrame]:
        return [d for part in self.gather(lambda r: r.exemplar_tables(text, start, end)) for d in part]


def _merge(found: list[DataFrame], merge: Callable[[list[DataFrame], str], DataFrame]) -> DataFrame | None:
    """Floats and histograms merged apart, each with its own base side; stale marks travel beside them."""
    if len(found) < 2:
        return found[0] if found else None
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.where("stale") for d in found])
    if not any("h" in d.columns for d in found):
        return merge([d.where("NOT stale") for d in found], "v").withColumn("stale", F.lit(False)).unionByName(every)
    kind = next(d.schema["h"].dataType for d in found if "h" in d.columns)
    full = [d if "h" in d.columns else d.withColumn("h", F.lit(None).cast(kind)) for d in found]
    floats = merge([d.where("NOT stale AND h IS NULL") for d in full], "v").withColumn("h", F.lit(None).cast(kind))
    hist = merge([d.where("NOT stale AND h IS NOT NULL") for d in full], "h").withColumn("v", F.lit(None).cast("double"))
    return floats.unionByName(hist).withColumn("stale", F.lit(False)).unionByName(every)


@dataclass
class Federation(Api):
    """Groups as shards of one store: the scan of an engine. All groups must answer; same label sets merge."""

    groups: list[Group]
    warnings: set[str] = field(default_factory=set)
    now: int = 0

    def __post_init__(self):
        for g in self.groups:
            g.warnings = self.warnings

    def session(self) -> SparkSession:
        return self.groups[0].session()

    def scan(self, matchers, low: int, high: int, now: int | None = None, request: Request | None = None) -> DataFrame:
        """Groups that differ in a label which every series of theirs has are put side by side; only the others merge."""
        now = now if now is not None or request else self.now
        kept: list[tuple[Group, DataFrame]] = [(g, d) for g in self.groups if (d := g.scan(matchers, low, high, now, request)) is not None]
        if not kept:
            return self.session().createDataFrame([], EMPTY)
        clusters: list[list[tuple[Group, DataFrame]]] = []
        for item in kept:
            near = [c for c in clusters if any(not apart(item[0], g) for g, _ in c)]
            clusters = [c for c in clusters if c not in near] + [[x for c in near for x in c] + [item]]
        merged = [_merge([d for _, d in c], lambda sides, value: merge_replicas(sides, 0, value=value)) for c in clusters]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), merged)

    def parts(self, matchers, low: int, high: int, now: int | None = None) -> list[DataFrame]:
        return [d for g in self.groups for d in g.parts(matchers, low, high, self.now if now is None else now)]

    def metadata_tables(self, metric: str) -> list[DataFrame]:
        return [d for g in self.groups for d in g.metadata_tables(metric)]

    def exemplar_tables(self, text: str, start: int, end: int) -> list[DataFrame]:
        return [d for g in self.groups for d in g.exemplar_tables(text, start, end)]


def apart(a: Group, b: Group) -> bool:
    """Whether no series of one group can have the labels of the other's: some label has decided, different values."""
    names = {k for g in (a, b) for r in g.replicas for k in r.labels}

    def values(g: Group, name: str) -> set[str | None]:
        return {r.known(name) for r in g.replicas}

    return any(None not in (x := values(a, n)) | (y := values(b, n)) and not x & y for n in names)
