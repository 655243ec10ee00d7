"""Reading a base: the only place where tables enter a query.

Row scoping, environment, time bounds and the base filter apply to raw columns;
then columns are masked as they are projected. Nothing downstream can undo it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import QueryError
from sluice.functions.masks import masked
from sluice.functions.values import Value, compare, contains, like_pattern, number
from sluice.plans.lexer import is_name, is_number
from sluice.plans.limits import EVENTTYPE_DEPTH
from sluice.plans.nodes import Compare, Free, Member, MetricBase, Saved, TableBase, Term
from sluice.plans.parser import filter_terms
from sluice.plans.scope import Scope
from sluice.sources.catalog import Catalog
from sluice.sources.schema import Base, Schema


def predicate(term: Compare | Member, v: Value, folded: bool) -> Column:
    """folded: text membership ignores case (the base filter's rule)."""
    if isinstance(term, Member):
        if not term.values:
            return F.lit(term.negate)
        if all(map(is_number, term.values)):
            found = v.number().isin(*(float(x) if "." in x else int(x) for x in term.values))
        elif folded and not term.negate:
            found = F.lower(v.text()).isin(*(x.lower() for x in term.values))
        else:
            found = v.text().isin(*term.values)
        return ~found if term.negate else found
    if term.kind == "regex":
        return v.text().rlike(term.value)
    if term.kind == "glob":
        found = v.text().ilike(like_pattern(term.value))
        return ~found if term.op == "!=" else found
    if term.kind == "num":
        return compare(term.op, v.number(), number(term.value))
    return compare(term.op, v.text(), F.lit(term.value))


class Leaf:
    def __init__(self, catalog: Catalog, schema: Schema, earliest: int, latest: int):
        self.catalog, self.schema, self.earliest, self.latest = catalog, schema, earliest, latest

    def read(self, base: TableBase | MetricBase) -> Scope:
        return self.metric(base) if isinstance(base, MetricBase) else self.table(base)

    def scoped(self, df: DataFrame, time: str | None) -> DataFrame:
        """Time bounds and the mandatory row filter."""
        if time and self.earliest > 0:
            df = df.where(F.col(time) >= self.earliest)
        if time and self.latest > 0:
            df = df.where(F.col(time) <= self.latest)
        if self.schema.row_filter is not None:
            column, ids = self.schema.row_filter
            df = df.where(F.col(column).isin(*ids) if ids and is_name(column) and column in df.columns else F.lit(False))
        return df

    def table(self, query: TableBase) -> Scope:
        base = self.schema.base(query.keyword)
        df = self.catalog.table(base.table, self.earliest, self.latest)
        df = self.scoped(df, base.time if base.time in df.columns else None)
        if self.schema.env and base.has_env:
            df = df.where(F.col("env_id") == self.schema.env)
        for term in query.terms:
            df = df.where(self.term(term, base, df, 0))
        columns = list(base.columns)
        if self.schema.cursor_id and "id" in (*base.columns, *base.filterable) and "id" not in columns:
            columns.append("id")
        masks = self.schema.masks
        picked = [masked(F.col(f"`{c}`"), masks[c], self.schema.salt).alias(c) if c in masks else F.col(f"`{c}`") for c in columns]
        return Scope(df.select(*picked), self.schema, base.bag)

    def term(self, term: Term, base: Base, df: DataFrame, depth: int) -> Column:
        if isinstance(term, Free):
            if base.freetext is None:
                raise QueryError(f"free terms are not supported here: {term.text!r}")
            if base.freetext in self.schema.masks:
                raise QueryError(f"free terms are not allowed: the field {base.freetext} is masked for your role")
            return contains(F.col(base.freetext), term.text)
        if isinstance(term, Saved):
            return self.saved(term, base, df, depth)
        return predicate(term, self.field(term.field, base, df), True)

    def field(self, name: str, base: Base, df: DataFrame) -> Value:
        """A field to filter on: raw, and refused where it is masked."""
        declared = {*base.columns, *base.filterable}
        if name not in declared:
            name = self.schema.knowledge.aliases.get(name, name)
        if name in self.schema.masks or name == base.bag and self.schema.masks:
            raise QueryError(f"filtering on a masked field is not allowed: {name}")
        if name in declared:
            return Value(F.col(f"`{name}`"), df.schema[name].dataType)
        if base.bag:
            return Value(F.get_json_object(F.col(base.bag), f"$.{name}"), T.StringType(), True)
        raise QueryError(f"unknown field: {name} (in scope: {', '.join(base.columns)})")

    def saved(self, term: Saved, base: Base, df: DataFrame, depth: int) -> Column:
        known = self.schema.knowledge
        found = F.lit(True)
        if term.kind == "eventtype" and known.eventtypes:
            if term.name not in known.eventtypes or not is_name(term.name):
                raise QueryError(f"unknown event type: {term.name}")
            if depth >= EVENTTYPE_DEPTH:
                raise QueryError(f"event types may be nested {EVENTTYPE_DEPTH} deep at most: {term.name}")
            for inner in filter_terms(known.eventtypes[term.name]):
                found = found & self.term(inner, base, df, depth + 1)
            return found
        if term.kind == "tag" and known.tags:
            if term.name not in known.tags:
                raise QueryError(f"unknown tag: {term.name}")
            found = F.lit(False)
            for field, value in known.tags[term.name]:
                if is_name(field):
                    found = found | predicate(Compare(field, "=", value, "text"), self.field(field, base, df), True)
            return found
        plain = Compare(term.kind, "=", term.name, "num" if is_number(term.name) else "glob" if "*" in term.name else "text")
        return predicate(plain, self.field(plain.field, base, df), True)

    def metric(self, query: MetricBase) -> Scope:
        """Raw and rolled-up values of one metric, in order of time."""

        def leaf(table: str, value: str) -> DataFrame:
            df = self.scoped(self.catalog.table(table, self.earliest, self.latest), "ts").where(F.col("name") == query.name)
            for label, text in query.labels:
                if label in self.schema.masks:
                    raise QueryError(f"filtering on a masked field is not allowed: {label}")
                df = df.where(F.get_json_object("labels", f"$.{label}") == text)
            if query.value:
                df = df.where(compare(query.value[0], F.col(value), F.lit(query.value[1])))
            label = lambda n: F.get_json_object("labels", f"$.{n}")
            by = [(masked(label(n), self.schema.masks[n], self.schema.salt) if n in self.schema.masks else label(n)).alias(n) for n in query.by]
            return df.select("ts", "host", F.col(value).alias("value"), *by)

        both = leaf("metric", "value").unionByName(leaf("metric_rollup", "avg"))
        return Scope(both.orderBy("ts"), self.schema, None)
