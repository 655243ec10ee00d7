"""Names in scope and what they mean. Every name becomes a column here and nowhere else."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import QueryError
from sluice.functions.masks import masked, without_keys
from sluice.functions.values import Value
from sluice.plans.lexer import is_name
from sluice.sources.schema import Schema

CALENDAR = frozenset("date day hour minute week month year time".split())


@dataclass(frozen=True)
class Scope:
    """A relation inside a query: df's columns are those in scope.

    bag is the raw JSON column's name if the base has one (it may have left the
    scope since). Its keys are read from it, so it stays raw until it is copied or
    the result leaves the query. loose: a limit picked the rows, and could pick
    others when they are read again.
    """

    df: DataFrame
    schema: Schema
    bag: str | None = None
    loose: bool = False

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def bag_in_scope(self) -> bool:
        return self.bag is not None and self.bag in self.columns

    def has(self, name: str) -> bool:
        return name in self.columns or self.schema.knowledge.aliases.get(name, name) in self.columns or self.bag_in_scope

    def value(self, name: str) -> Value:
        """A live column; else what an alias stands for; else a key of the bag."""
        if not is_name(name):
            raise QueryError(f"invalid field: {name}")
        if name not in self.columns:
            name = self.schema.knowledge.aliases.get(name, name)
        if name == self.bag and name in self.columns:
            return Value(self.redacted(), T.StringType())
        if name in self.columns:
            return Value(F.col(f"`{name}`"), self.df.schema[name].dataType)
        if self.bag_in_scope:
            return Value(self.key(name), T.StringType(), True)
        for c in self.columns if self.bag else ():
            if c.lower() == name.lower():
                return self.value(c)
        raise QueryError(f"unknown field: {name} (in scope: {', '.join(self.columns)})")

    def key(self, name: str) -> Column:
        found = F.get_json_object(F.col(f"`{self.bag}`"), f"$.{name}")
        mask = self.schema.masks.get(name)
        return masked(found, mask, self.schema.salt) if mask else found

    def redacted(self) -> Column:
        """The bag without masked keys, whatever columns have their names."""
        return without_keys(F.col(f"`{self.bag}`"), sorted(self.schema.masks))

    def grouped(self, names: Iterable[str], stage: str) -> list[Column]:
        out = []
        for name in names:
            if not self.has(name):
                hint = ""
                if name.lower() in CALENDAR:
                    hint = " - to group by time use timechart span=<duration> <aggregate> [by field]"
                elif self.bag and not self.bag_in_scope:
                    hint = " - keys of the bag are out of scope after an aggregation or projection; group by it in the first stats, or keep it with fields"
                elif self.bag is None and {"ts", "host", "value"} <= set(self.columns):
                    hint = " - a metric's label is declared on the base: metric <name> by <label>"
                raise QueryError(f"{stage}: unknown field in by: {name} (in scope: {', '.join(self.columns)}){hint}")
            out.append(self.value(name).column.alias(name))
        return out

    def over(self, df: DataFrame, loose: bool = False) -> Scope:
        return Scope(df, self.schema, self.bag, loose)

    def output(self) -> DataFrame:
        """What leaves a query: the bag goes out redacted."""
        if self.bag_in_scope and self.schema.masks:
            return self.df.withColumn(self.bag, self.redacted())
        return self.df
