"""The syntax tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Compare:
    """field op value; kind is num, text, regex or glob."""

    field: str
    op: str
    value: str
    kind: str


@dataclass(frozen=True)
class Member:
    field: str
    negate: bool
    values: tuple[str, ...]


@dataclass(frozen=True)
class Free:
    """A term or phrase looked for in the free-text column."""

    text: str


@dataclass(frozen=True)
class Saved:
    """eventtype=name or tag=label."""

    kind: str
    name: str


Term = Compare | Member | Free | Saved


@dataclass(frozen=True)
class TableBase:
    keyword: str
    terms: tuple[Term, ...]


@dataclass(frozen=True)
class MetricBase:
    name: str
    labels: tuple[tuple[str, str], ...] = ()
    value: tuple[str, float] | None = None
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    function: str = "count"
    field: str | None = None


@dataclass(frozen=True)
class Stage:
    """One pipe stage; what args holds depends on name (see the parser)."""

    name: str
    args: dict = field(default_factory=dict)

    @property
    def loose(self) -> bool:
        """Whether it, or a subsearch of it, picks rows by a limit."""
        return self.name in ("head", "limit") or any(isinstance(v, Query) and any(s.loose for s in v.stages) for v in self.args.values())


@dataclass(frozen=True)
class Query:
    base: TableBase | MetricBase
    stages: tuple[Stage, ...]

    def size(self) -> int:
        """Terms, stages and expression nodes, subsearches included."""

        def inside(value) -> int:
            if isinstance(value, Query):
                return value.size()
            if isinstance(value, tuple):
                return 1 + sum(map(inside, value))
            return 0

        return len(getattr(self.base, "terms", ())) + 1 + sum(1 + sum(map(inside, s.args.values())) for s in self.stages)
