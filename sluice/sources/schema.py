"""Declared tables and the restrictions under which a caller reads them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Keys of the event bag that are always text.
HOT_FIELDS = ("action", "user", "owner", "kind", "ns", "role", "scope", "verb", "resource", "operation", "dir", "risk")

MASKS = ("mask", "partial", "hash", "redact", "deny")


@dataclass(frozen=True)
class Base:
    """A table that queries may start from.

    columns are projected; filterable ones may be filtered on as well. bag names
    the JSON column that unknown names are looked up in; freetext the column that
    bare terms search.
    """

    keyword: str
    table: str
    columns: tuple[str, ...]
    filterable: tuple[str, ...] = ()
    bag: str | None = None
    freetext: str | None = None
    has_env: bool = False
    time: str | None = "ts"


@dataclass(frozen=True)
class Knowledge:
    """Saved objects. Definitions with invalid names are ignored.

    aliases: name to source field; calculated: (name, expression), in order;
    eventtypes: name to filter; tags: label to (field, value) pairs; macros: name
    to (parameters, body); lookups: (table, key field, output columns).
    """

    aliases: dict[str, str] = field(default_factory=dict)
    calculated: tuple[tuple[str, str], ...] = ()
    eventtypes: dict[str, str] = field(default_factory=dict)
    tags: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)
    macros: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    lookups: tuple[tuple[str, str, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class Schema:
    default: Base
    alternatives: tuple[Base, ...] = ()
    metric: bool = False
    mitre_rollup: bool = False
    env: str | None = None
    masks: dict[str, str] = field(default_factory=dict)
    salt: str = ""
    knowledge: Knowledge = field(default_factory=Knowledge)
    row_filter: tuple[str, tuple[int, ...]] | None = None
    cursor_id: bool = False
    message_pruning: bool = False

    def base(self, keyword: str) -> Base:
        return next((b for b in self.alternatives if b.keyword == keyword), self.default)

    def with_env(self, env: str | None) -> Schema:
        return replace(self, env=env or None)

    def with_masks(self, masks: dict[str, str], salt: str = "") -> Schema:
        unknown = set(masks.values()) - set(MASKS)
        if unknown:
            raise ValueError(f"unknown masks: {sorted(unknown)}")
        return replace(self, masks=dict(masks), salt=salt)

    def with_knowledge(self, knowledge: Knowledge) -> Schema:
        return replace(self, knowledge=knowledge)

    def with_row_filter(self, column: str, ids: list[int]) -> Schema:
        """Only rows whose column is one of ids are ever read; none if ids is empty."""
        return replace(self, row_filter=(column, tuple(int(i) for i in ids)))

    def with_cursor_id(self) -> Schema:
        return replace(self, cursor_id=True)

    def with_message_pruning(self) -> Schema:
        """Kept for callers; the optimiser reads only used columns anyway."""
        return replace(self, message_pruning=True)


def events() -> Schema:
    """Security events with a JSON bag, metrics and lookups."""
    columns = ("ts", "host", "source", "category", "severity", "src_ip", "dst_ip", "url", "xff", "message", "fields")
    return Schema(Base("search", "event", columns, ("dedup", "id"), "fields", "message", True), metric=True)


def engagements() -> Schema:
    """Findings and run records, joined by technique."""
    finding = Base("search", "finding", ("ts", "campaign", "target", "title", "severity", "category", "mitre", "status", "evidence", "tool", "poc"), ("engagement_id",), None, "title")
    runs = Base("runs", "runrecord", ("ts", "campaign", "target", "kind", "mitre", "fired", "detail"), ("engagement_id",), None, "detail")
    return Schema(finding, (runs,), mitre_rollup=True)
