"""Bounds on untrusted query text; each can be lowered or raised by an environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass

from sluice.errors import ConfigError, QueryError

SUBSEARCH_DEPTH, EVENTTYPE_DEPTH = 3, 4
MACRO_EXPANSIONS, MACRO_CHARS = 64, 65_536
LIST_CHARS = 4_096


@dataclass(frozen=True)
class Limits:
    """span_secs: largest timechart bucket; stages: pipe stages; text_bytes: query
    text; plan_nodes: parsed filter terms, stages and expression nodes in all."""

    span_secs: int = 315_360_000
    stages: int = 64
    text_bytes: int = 1_048_576
    plan_nodes: int = 100_000

    CEILINGS = {"span_secs": 315_360_000, "stages": 1_024, "text_bytes": 16_777_216, "plan_nodes": 1_600_000}

    @classmethod
    def from_environment(cls, prefix: str = "SLUICE_MAX_") -> Limits:
        given = {}
        for name, most in cls.CEILINGS.items():
            raw = os.environ.get(prefix + name.upper())
            if raw is None:
                continue
            if not raw.isascii() or not raw.isdigit() or not 0 < int(raw) <= most:
                raise ConfigError(f"{prefix}{name.upper()}={raw!r} is not a whole number from 1 to {most}")
            given[name] = int(raw)
        return cls(**given)

    def check(self, name: str, value: int, what: str) -> None:
        if value > getattr(self, name):
            raise QueryError(f"{what}: {value} is more than {getattr(self, name)}")
