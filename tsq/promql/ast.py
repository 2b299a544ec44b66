"""Syntax tree of the query language. Times and durations are milliseconds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class String:
    value: str


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str

    def __str__(self) -> str:
        text = self.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        return f'{self.name}{self.op}"{text}"'


@dataclass(frozen=True)
class Selector:
    """An instant selector, or with ``range`` a range selector."""

    matchers: tuple[Matcher, ...]
    range: int | None = None
    offset: int = 0
    at: int | str | None = None

    @property
    def name(self) -> str | None:
        return next((m.value for m in self.matchers if m.name == "__name__" and m.op == "="), None)


@dataclass(frozen=True)
class Subquery:
    expr: object
    range: int
    step: int | None
    offset: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    expr: object
    param: object = None
    grouping: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False
    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] = ()
    card: str = "one"
    include: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Negate:
    expr: object


def walk(node):
    """The node and all nodes below it."""
    yield node
    for child in (getattr(node, k, None) for k in ("expr", "left", "right", "param")):
        if child is not None:
            yield from walk(child)
    for child in getattr(node, "args", ()):
        yield from walk(child)
