"""A federation of sources from a configuration: groups of tables, their target relabelling, wrappers and merge policy.

The configuration is a mapping, or JSON text of one (YAML where a reader for it is installed). Transport keys have no
meaning here and are kept in the dump only; unknown keys are errors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.promql.parser import duration_ms, parse, parse_selector, selectors
from tsq.sources.source import Federation, Group, LabelFilter, Relabel, Source, TimeBounds

DEFAULT_BUFFER = "10s"
#: Keys of a group that this engine acts on, and those of the transport, which it has none of.
USED = {
    "name", "static_configs", "labels", "relabel_configs", "metrics_relabel_configs", "anti_affinity", "anti_affinity_dynamic", "ignore_error", "downgrade_error",
    "relative_time_range", "absolute_time_range", "label_filter", "inject_matchers", "prefer_max", "align_query_range_with_step",
}
TRANSPORT = {
    "remote_read", "remote_read_path", "native_histogram", "http_client", "scheme", "path_prefix", "query_params", "timeout", "max_idle_conns",
    "max_idle_conns_per_host", "idle_conn_timeout", "http_headers",
}


class ConfigError(ValueError):
    pass


def span_ms(value: str | int) -> int:
    """A duration with a sign, or milliseconds."""
    if isinstance(value, int):
        return value
    return -duration_ms(value[1:]) if value.startswith("-") else duration_ms(value)


def instant_ms(value: str | int) -> int:
    if isinstance(value, int):
        return value
    return round(datetime.fromisoformat(value.replace("Z", "+00:00")).timestamp() * 1000)


@dataclass(frozen=True)
class TargetRelabel:
    """One step over a target's labels: a pattern on joined source labels decides, or makes a new value."""

    action: str = "replace"
    source_labels: tuple[str, ...] = ()
    separator: str = ";"
    regex: str = "(.*)"
    target_label: str = ""
    replacement: str = "$1"
    modulus: int = 0

    @classmethod
    def of(cls, config: Mapping) -> TargetRelabel:
        return cls(**{**config, "source_labels": tuple(config.get("source_labels", ()))})

    def __post_init__(self):
        if self.action not in ("replace", "keep", "drop", "keepequal", "dropequal", "hashmod", "labelmap", "labeldrop", "labelkeep", "lowercase", "uppercase"):
            raise ConfigError(f"unknown action {self.action}")
        if self.action in ("replace", "hashmod", "lowercase", "uppercase", "keepequal", "dropequal") and not self.target_label:
            raise ConfigError(f"{self.action} needs target_label")
        if self.action == "hashmod" and self.modulus < 1:
            raise ConfigError("hashmod needs a modulus")
        re.compile(self.regex)

    def apply(self, labels: dict[str, str]) -> dict[str, str] | None:
        """The labels after the step, or null where the target goes."""
        value = self.separator.join(labels.get(x, "") for x in self.source_labels)
        hit = re.fullmatch(self.regex, value, re.S)
        if self.action in ("keep", "drop"):
            return labels if (hit is not None) == (self.action == "keep") else None
        if self.action in ("keepequal", "dropequal"):
            return labels if (value == labels.get(self.target_label, "")) == (self.action == "keepequal") else None
        if self.action in ("labeldrop", "labelkeep"):
            return {k: v for k, v in labels.items() if (re.fullmatch(self.regex, k, re.S) is None) == (self.action == "labeldrop")}
        if self.action == "labelmap":
            mapped = {_expand(m, self.replacement): v for k, v in labels.items() if (m := re.fullmatch(self.regex, k, re.S))}
            return labels | mapped
        if self.action == "hashmod":
            new = str(int.from_bytes(hashlib.md5(value.encode()).digest()[8:], "big") % self.modulus)
        elif self.action in ("lowercase", "uppercase"):
            new = value.lower() if self.action == "lowercase" else value.upper()
        elif hit is None:
            return labels
        else:
            new = _expand(hit, self.replacement)
        return {k: v for k, v in (labels | {self.target_label: new}).items() if v}


def _expand(hit: re.Match, template: str) -> str:
    def group(m: re.Match) -> str:
        name = m[1] or m[2]
        return hit[int(name) if name.isdigit() else name] or ""

    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", group, template)


def targets(group: Mapping) -> list[tuple[str, dict[str, str]]]:
    """(address, added labels) of a group's targets that relabelling keeps; labels that start with two underscores go."""
    steps = [TargetRelabel.of(c) for c in group.get("relabel_configs", ())]
    out = []
    for static in group.get("static_configs", ()):
        for address in static["targets"]:
            labels: dict[str, str] | None = {"__address__": address, **static.get("labels", {})}
            for step in steps:
                labels = labels if labels is None else step.apply(labels)
            if labels is None:
                continue
            if not labels.get("__address__"):
                raise ConfigError("a target has lost its address")
            out.append((labels["__address__"], {k: v for k, v in labels.items() if not k.startswith("__")}))
    return out


def read_config(config: Mapping | str) -> Mapping:
    if not isinstance(config, str):
        return config
    try:
        return json.loads(config)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("not JSON, and no YAML reader is installed") from e
        return yaml.safe_load(config)


class SourceRegistry:
    """Builds the federation that a configuration describes; ``open_table(address)`` gives a sample frame or a scan."""

    def __init__(self, config: Mapping | str, open_table: Callable[[str], DataFrame | Callable]):
        self.config, self.open_table = read_config(config), open_table
        groups = self.config.get("server_groups", ())
        if not groups:
            raise ConfigError("no server_groups")
        for g in groups:
            if unknown := set(g) - USED - TRANSPORT:
                raise ConfigError(f"unknown keys {sorted(unknown)}")
        self.federation = Federation([self._group(g) for g in groups])

    def _group(self, group: Mapping) -> Group:
        found = [self._source(group, address, labels) for address, labels in targets(group)]
        if not found:
            raise ConfigError(f"group {group.get('name', '')!r} has no target")
        buffer = span_ms(group.get("anti_affinity", DEFAULT_BUFFER))
        return Group(found, buffer, dynamic=group.get("anti_affinity_dynamic", False), prefer_max=group.get("prefer_max", False))

    def _source(self, group: Mapping, address: str, labels: dict[str, str]) -> Source:
        samples = _late(self.open_table, address)
        inject = tuple(m for text in group.get("inject_matchers", ()) for m in parse_selector("x{" + text + "}").matchers if m.name != "__name__" or m.value != "x")
        steps = tuple(Relabel(c.get("action", "replace"), c.get("source_label") or c.get("regex", ""), c.get("target_label", "")) for c in group.get("metrics_relabel_configs", ()))
        bounds = tuple(
            TimeBounds(*[None if r.get(k) is None else to(r[k]) for k in ("start", "end")], relative=relative, truncate=r.get("truncate", False))
            for key, to, relative in (("absolute_time_range", instant_ms, False), ("relative_time_range", span_ms, True))
            if (r := group.get(key))
        )
        return Source(
            samples, f"{group.get('name', '')}/{address}", {**group.get("labels", {}), **labels}, inject, steps, bounds,
            self._filter(group, samples), group.get("align_query_range_with_step", False), group.get("ignore_error", False), group.get("downgrade_error", False),
        )

    def _filter(self, group: Mapping, samples) -> LabelFilter | None:
        config = group.get("label_filter")
        if not config:
            return None
        fixed, excluded = ({k: set(v) for k, v in config.get(f"static_labels_{x}", {}).items()} for x in ("include", "exclude"))
        names = list(dict.fromkeys([*config.get("dynamic_labels", ()), *fixed]))
        dynamic = set(config.get("dynamic_labels", ()))
        if not dynamic:
            return LabelFilter({k: frozenset(fixed.get(k, set()) - excluded.get(k, set())) for k in names})
        frame = samples((), -(2**53), 2**53)
        return LabelFilter.collect(frame, names, fixed, excluded)

    def dump(self) -> str:
        """The configuration as it was read."""
        try:
            import yaml
        except ImportError:
            return json.dumps(self.config, indent=2, sort_keys=True)
        return yaml.safe_dump(self.config, sort_keys=True)


def _late(open_table: Callable[[str], DataFrame | Callable], address: str) -> Callable:
    """A scan that opens its table when it is asked, so that a missing one is an error of that call."""

    def scan(matchers, low: int, high: int) -> DataFrame:
        from tsq.sources.tables import scan_of

        table = open_table(address)
        return (scan_of(table) if isinstance(table, DataFrame) else table)(matchers, low, high)

    return scan


class HistogramNames:
    """The names of native histograms, from metadata; refreshed on demand, united over all sources."""

    def __init__(self, tables: Callable[[], list[DataFrame]]):
        self.tables, self.names = tables, frozenset[str]()

    def refresh(self, most: int = 100_000) -> HistogramNames:
        """Reads at most ``most`` names; with more, every query counts as one over histograms."""
        found: set[str] = set()
        for t in self.tables():
            found |= {r["metric"] for r in t.where(F.lower("type") == "histogram").select("metric").distinct().limit(most + 1).collect()}
        self.names = frozenset(found) if len(found) <= most else None
        return self

    def concern(self, text: str) -> bool:
        """Whether a query selects a histogram by name, or by a pattern or no name at all while there is one."""
        from tsq.sources.source import holds

        if self.names is None:
            return True
        for s in selectors(parse(text)):
            on_name = [m for m in s.matchers if m.name == "__name__"]
            if any(all(holds(m, n) for m in on_name) for n in self.names):
                return True
        return False


