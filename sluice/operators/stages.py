"""The pipe stages: each takes the relation so far and gives the next one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from sluice.errors import QueryError
from sluice.functions import scalars
from sluice.functions.values import Value, aggregate, listed, sort_key
from sluice.plans.lexer import is_name
from sluice.plans.limits import LIST_CHARS
from sluice.plans.nodes import Aggregate, Query, Stage
from sluice.plans.scope import Scope
from sluice.sources.leaf import predicate

#: Lookup tables up to this many bytes by the optimiser's estimate are broadcast by hint; larger ones are left to it.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> bool:
    """Whether the optimiser's own size estimate allows a broadcast hint; without one (a remote session) it is left to the optimiser."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except (AttributeError, PySparkException):
        return False
    return int(str(size)) <= BROADCAST_BYTES


def q(name: str) -> Column:
    """A column by its exact name. Names that only a stage uses begin with #, which no field name does."""
    return F.col(f"`{name}`")


class Stages:
    """run: builds a subsearch's output relation; catalog gives lookups."""

    def __init__(self, catalog, run: Callable[[Query], DataFrame]):
        self.catalog, self.run = catalog, run

    def apply(self, stage: Stage, s: Scope) -> Scope:
        return s.over(getattr(self, stage.name)(s, **stage.args), s.loose or stage.loose)

    def _measured(self, s: Scope, a: Aggregate, over: WindowSpec | None = None) -> Column:
        return aggregate(a, s.value(a.field) if a.field else None, over)

    def _grouped(self, s: Scope, a: Aggregate, keys: list[Column], names: list[str], made: str | None = None) -> DataFrame:
        """keys (called names) and the aggregate, called made or after its function."""
        made = made or a.function
        if made in names:
            raise QueryError(f"the field {made} has the name of the aggregate")
        if a.function not in ("values", "list"):
            return s.df.groupBy(*keys).agg(self._measured(s, a).alias(made))
        counted = s.df.select(*keys, s.value(a.field).text().alias("#v")).groupBy(*(q(n) for n in names), "#v").agg(F.count(F.lit(1)).alias("#n"))
        return joined(counted, names, "#v", "#n", a.function == "list", made)

    def stats(self, s: Scope, aggregate: Aggregate, by: tuple[str, ...]) -> DataFrame:
        return self._grouped(s, aggregate, s.grouped(by, "stats"), list(by))

    def timechart(self, s: Scope, aggregate: Aggregate, by: tuple[str, ...], span: int) -> DataFrame:
        if "ts" not in s.columns:
            raise QueryError("timechart: the field ts is not in scope")
        keys = [F.expr(f"ts div {int(span)} * {int(span)}").cast("long").alias("bucket"), *s.grouped(by, "timechart")]
        return self._grouped(s, aggregate, keys, ["bucket", *by]).orderBy("bucket")

    def where(self, s: Scope, term) -> DataFrame:
        return s.df.where(predicate(term, s.value(term.field), False))

    def sort(self, s: Scope, field: str, descending: bool) -> DataFrame:
        key = sort_key(s.value(field))
        return s.df.orderBy(key.desc() if descending else key.asc())

    def head(self, s: Scope, n: int) -> DataFrame:
        return s.df.limit(n)

    limit = head

    def rex(self, s: Scope, field: str, pattern: str) -> DataFrame:
        """Named groups become columns; null where the pattern does not match."""
        plain, groups = numbered(pattern)
        source = s.value(field).text()
        df = s.df
        for name, at in groups.items():
            found = F.regexp_extract(source, plain, at)
            df = df.withColumn(name, F.when(source.rlike(plain), found))
        return df

    def fields(self, s: Scope, names: tuple[str, ...]) -> DataFrame:
        return s.df.select(*(self._kept(s, n) for n in dict.fromkeys(names)))

    def _kept(self, s: Scope, name: str) -> Column:
        # The bag stays raw inside the query, as its keys may be asked for later.
        return q(name) if name in s.columns else s.value(name).column.alias(name)

    def table(self, s: Scope, names: tuple[str, ...] | None) -> DataFrame:
        return s.df if names is None else self.fields(s, names)

    def rename(self, s: Scope, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
        """Additive: the old column stays."""
        return s.df.withColumns({new: s.value(old).column for old, new in pairs})

    def dedup(self, s: Scope, names: tuple[str, ...]) -> DataFrame:
        """One row for each key: the smallest by time, then by all columns.

        The least row is an aggregate, so that rows of a frequent key are reduced
        before they are shuffled.
        """
        keys = [s.value(n).column.alias(f"#k{i}") for i, n in enumerate(names)]
        first = [c for c in s.columns if c == "ts"] + [c for c in s.columns if c != "ts"]
        row = F.struct(*(part for c in first for part in (q(c).isNull().alias(f"#{c}"), q(c).alias(c))))
        least = s.df.groupBy(*keys).agg(F.min(row).alias("#row"))
        return least.select(*(q("#row").getField(c).alias(c) for c in s.columns))

    def _counted(self, s: Scope, field: str) -> DataFrame:
        if field == "count":
            raise QueryError("the field count has the name of the aggregate")
        return s.df.groupBy(s.value(field).column.alias(field)).agg(F.count(F.lit(1)).alias("count"))

    def top(self, s: Scope, n: int, field: str) -> DataFrame:
        return self._counted(s, field).orderBy(F.desc("count"), q(field)).limit(n)

    def rare(self, s: Scope, n: int, field: str) -> DataFrame:
        return self._counted(s, field).orderBy("count", q(field)).limit(n)

    def eventstats(self, s: Scope, aggregate: Aggregate, by: tuple[str, ...]) -> DataFrame:
        """The group's aggregate on every row.

        Groups are aggregated first, with partial sums, and joined back on their
        keys: a window would bring all rows of a frequent key (or all rows, without
        keys) to one task. Only where rows were picked by a limit, which can pick
        others when it is read again, a window reads them once; they are few.
        """
        keys = s.grouped(by, "eventstats")
        others = [c for c in s.columns if c != aggregate.function]
        if s.loose:
            w = Window.partitionBy(*(keys or [F.lit(0)]))
            return s.df.select(*(q(c) for c in others), self._measured(s, aggregate, w).alias(aggregate.function))
        names = [f"#k{i}" for i in range(len(by))]
        made = self._grouped(s, aggregate, [c.alias(n) for c, n in zip(keys, names, strict=True)], names, "#made")
        if not by:
            found = s.df.crossJoin(F.broadcast(made))  # made is one row
        else:
            left = s.df.select("*", *(c.alias(f"#l{i}") for i, c in enumerate(keys)))
            on = None
            for i, n in enumerate(names):
                same = q(f"#l{i}").eqNullSafe(q(n))
                on = same if on is None else on & same
            found = left.join(made, on, "left")
        return found.select(*(q(c) for c in others), q("#made").alias(aggregate.function))

    def rate(self, s: Scope) -> DataFrame:
        """Change of value by second within each series; null for a drop or no time.

        Rows of one series at one time are taken in the order of their values.
        """
        if not {"ts", "value"} <= set(s.columns):
            raise QueryError("rate: the fields ts and value are needed")
        w = Window.partitionBy(*(q(c) for c in s.columns if c not in ("ts", "value", "rate"))).orderBy("ts", "value")
        rise, time = F.col("value") - F.lag("value").over(w), F.col("ts") - F.lag("ts").over(w)
        timed = s.df.withColumns({"#rise": rise, "#time": time})
        return timed.withColumn("rate", F.when((q("#rise") >= 0) & (q("#time") > 0), q("#rise") / q("#time"))).drop("#rise", "#time")

    def eval(self, s: Scope, name: str, tree: tuple) -> DataFrame:
        def resolve(field: str) -> Value:
            return s.value(s.bag) if s.bag_in_scope and field.lower() == s.bag.lower() else s.value(field)

        made = scalars.build(tree, resolve)
        return s.df.withColumn(name, made.column.cast("string") if isinstance(made.kind, T.NullType) else made.column)

    def append(self, s: Scope, query: Query) -> DataFrame:
        """By name; columns that one side lacks are null, unlike types become text."""
        right, left = self.run(query), s.df
        for c in set(left.columns) & set(right.columns):
            a, b = left.schema[c].dataType, right.schema[c].dataType
            if a != b and not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
                left, right = left.withColumn(c, q(c).cast("string")), right.withColumn(c, q(c).cast("string"))
        return left.unionByName(right, allowMissingColumns=True)

    def join(self, s: Scope, field: str, query: Query) -> DataFrame:
        """Left join on one field; of columns that both have the left's stays."""
        right = self.run(query)
        for side, columns in (("left", s.columns), ("right", right.columns)):
            if field not in columns:
                raise QueryError(f"join: the field {field} is not on the {side} side (in scope: {', '.join(columns)})")
        more = [c for c in right.columns if c not in s.columns]
        if field == "mitre" and s.schema.mitre_rollup:
            key, other = parent(q(field)), parent(q("#key"))
        else:
            key, other = q(field), q("#key")
            if s.df.schema[field].dataType != right.schema[field].dataType:
                key, other = key.cast("string"), other.cast("string")
        named = right.select(q(field).alias("#key"), *(q(c) for c in more))
        return s.df.join(named, key == other, "left").select(*(q(c) for c in [*s.columns, *more]))

    def mvexpand(self, s: Scope, field: str) -> DataFrame:
        """A row for each element of a JSON array (or value of an object; a lone scalar is itself)."""
        df = s.df.withColumn("#text", F.trim(s.value(field).text())).withColumn("#v", F.try_parse_json("#text"))
        text, parsed = q("#text"), q("#v")
        values = F.when(
            parsed.isNotNull(),
            F.when(text.startswith("["), F.from_json(text, "array<string>"))
            .when(text.startswith("{"), F.transform(F.map_values(F.try_variant_get(parsed, "$", "map<string,variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))
            .otherwise(F.array(parsed.cast("string"))),
        )
        others = [c for c in s.columns if c != field]
        df = df.select(*(q(c) for c in others), F.explode(values).alias(field))
        return df.select(*(q(c) for c in (s.columns if field in s.columns else [*s.columns, field])))

    def lookup(self, s: Scope, table: str, key: str, output: tuple[str, ...]) -> DataFrame:
        """Left join with the named reference table; OUTPUT columns come from its JSON."""
        kv = self.catalog.table("lookup_kv").where(F.col("name") == table)
        value = [F.when(F.try_parse_json("val").isNotNull(), F.get_json_object("val", f"$.{c}")).alias(f"#o{i}") for i, c in enumerate(output)]
        kv = kv.select(F.col("key").cast("string").alias("#key"), *(value or [F.col("val").alias("#o0")]))
        added = output or (table,)
        joined = s.df.join(F.broadcast(kv) if small(kv) else kv, s.value(key).text() == q("#key"), "left")
        others = [c for c in s.columns if c not in added]
        made = joined.select(*(q(c) for c in others), *(q(f"#o{i}").alias(c) for i, c in enumerate(added)))
        return made.select(*(q(c) for c in [*s.columns, *(c for c in added if c not in s.columns)]))


def joined(counted: DataFrame, names: list[str], value: str, times: str, repeated: bool, made: str) -> DataFrame:
    """For each group of names its sorted values joined by commas, LIST_CHARS at most; null for none.

    counted has each value of a group once, with how often it occurs. Only the first
    values, whose characters fill the limit, are gathered: first within parts of a
    group, then within the group, by windows that spill. So no group is held whole,
    and a group with a third of all values is cut by many tasks.
    """
    keys = [q(n) for n in names]
    text, often = q(value), q(times) if repeated else F.lit(1)
    cost = F.when(text.isNotNull(), ((F.least(F.length(text), F.lit(LIST_CHARS)) + 1) * F.least(often, F.lit(LIST_CHARS))).cast("long"))
    for part in (F.pmod(F.xxhash64(text), F.lit(64)), F.lit(0)):
        w = Window.partitionBy(*keys, part).orderBy(text).rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("#before", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(q("#before") <= LIST_CHARS).drop("#before")
    short = F.substring(text, 1, LIST_CHARS)
    each = F.when(text.isNotNull(), F.array_repeat(short, F.least(often, F.lit(LIST_CHARS)).cast("int")) if repeated else F.array(short))
    return counted.groupBy(*keys).agg(listed(F.flatten(F.collect_list(each))).alias(made))


def parent(c: Column) -> Column:
    """The parent technique: what stands before the first dot, in capitals."""
    return F.upper(F.substring_index(c, ".", 1))


def numbered(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with named groups as one with plain groups, and the names' numbers."""
    groups, count, out, i, klass = {}, 0, "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out += pattern[i : i + 2]
            i += 2
            continue
        if klass:
            klass = c != "]"
        elif c == "[":
            klass = True
            if pattern[i + 1 : i + 2] == "]":
                out, i = out + "[\\", i + 1
                continue
        elif c == "(":
            named = re.match(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", pattern[i:])
            if named:
                count += 1
                if not is_name(named[1]) or named[1] in groups:
                    raise QueryError(f"rex: invalid group name: {named[1]}")
                groups[named[1]] = count
                out += "("
                i += len(named[0])
                continue
            if pattern[i + 1 : i + 2] != "?":
                count += 1
        out += c
        i += 1
    return out, groups
