"""Recording and alerting rules over an engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.model import NAME, drop_name, key_of, match, with_labels
from tsq.plans.engine import Engine
from tsq.promql.ast import Matcher


@dataclass(frozen=True)
class RecordingRule:
    record: str
    expr: str
    labels: Mapping[str, str] = field(default_factory=dict)

    def evaluate(self, engine: Engine, start: int, end: int, step: int) -> DataFrame:
        """Samples under the rule's name."""
        df = engine.query_range(self.expr, start, end, step)
        return df.withColumn("labels", with_labels(F.col("labels"), {**self.labels, NAME: self.record}))


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class AlertingRule:
    alert: str
    expr: str
    for_ms: int = 0
    labels: Mapping[str, str] = field(default_factory=dict)
    annotations: Mapping[str, str] = field(default_factory=dict)

    def evaluate(self, engine: Engine, start: int, end: int, step: int) -> DataFrame:
        """``(labels, t, v, active_at, state)``: pending until the rule has held for ``for_ms``, then firing."""
        df = engine.query_range(self.expr, start, end, step)
        df = df.withColumn("labels", with_labels(drop_name(), {**self.labels, "alertname": self.alert}))
        state = F.when(F.col("t") - F.col("active_at") >= self.for_ms, "firing").otherwise("pending")
        return activations(df, step).withColumn("state", state)


def activations(df: DataFrame, step: int) -> DataFrame:
    """Adds ``active_at``, the start of each unbroken run of steps; a gap of more than a step starts a new run."""
    series = Window.partitionBy("_key").orderBy("t")
    marked = df.withColumn("_key", key_of())
    broken = F.col("t") - F.lag("t").over(series) > step
    marked = marked.withColumn("_new", F.when(F.coalesce(broken, F.lit(True)), F.col("t")))
    return marked.withColumn("active_at", F.max("_new").over(series)).drop("_key", "_new")


def alert_state(df: DataFrame, step: int, labels: Mapping[str, str], matchers=()) -> DataFrame:
    """Activation times in seconds by step, for restoring ``for`` state: rule labels overlaid, then filtered."""
    out = activations(df, step).select("labels", "t", (F.col("active_at") / 1000.0).alias("v"))
    return out.withColumn("labels", with_labels(drop_name(), labels)).where(match(matchers))


def run_rules(rules, engine: Engine, sink, start: int, end: int, step: int) -> None:
    """Evaluates rules and writes their samples; a recording rule without a sink is refused before any runs."""
    if sink is None and any(isinstance(r, RecordingRule) for r in rules):
        raise RuleError("a recording rule needs a sample table to write to")
    for rule in rules:
        df = rule.evaluate(engine, start, end, step)
        if sink is not None:
            sink(df)


def backfill(engine: Engine, rule: AlertingRule, interval: int, now: int, stored: DataFrame | None = None, cache: dict | None = None) -> DataFrame:
    """The rule's stored activation samples if there are any, else those of the rule run over the last ``for`` plus one
    interval. ``cache`` keeps what was run by rule and time."""
    labels = {**rule.labels, NAME: "ALERTS_FOR_STATE", "alertname": rule.alert}
    if stored is not None:
        own = stored.where(match([Matcher(k, "=", v) for k, v in labels.items()]))
        if own.limit(1).count():
            return own
    key = (rule.alert, rule.expr, tuple(sorted(rule.labels.items())), interval, now)
    if cache is not None and key in cache:
        return cache[key]
    start = now - rule.for_ms - interval
    start += (now - start) % interval
    out = alert_state(engine.query_range(rule.expr, start, now, interval), interval, labels)
    if cache is not None:
        cache[key] = out
    return out


def find_rule(groups: Mapping[str, tuple[int, list[AlertingRule]]], name: str, matchers) -> tuple[AlertingRule, int] | None:
    """The first rule of that name whose labels satisfy the matchers it has, and its group's interval."""
    from tsq.sources.source import holds

    for interval, rules in groups.values():
        for rule in rules:
            if rule.alert == name and all(holds(m, rule.labels[m.name]) for m in matchers if m.name in rule.labels):
                return rule, interval
    return None


def to_send(alerts: DataFrame) -> DataFrame:
    """Alerts that are past pending."""
    return alerts.where("state <> 'pending'")

