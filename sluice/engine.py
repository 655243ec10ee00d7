"""Query text to a lazy DataFrame."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.errors import QueryError
from sluice.operators.stages import Stages
from sluice.plans import expressions, parser
from sluice.plans.lexer import is_name
from sluice.plans.limits import Limits
from sluice.plans.macros import expand
from sluice.plans.nodes import MetricBase, Query, Stage
from sluice.sources.catalog import Catalog
from sluice.sources.leaf import Leaf
from sluice.sources.schema import Schema

#: What an editor may complete; all of it runs.
COMPLETIONS = {"commands": parser.COMMANDS, "aggregates": parser.AGGREGATES, "functions": expressions.FUNCTIONS, "operators": parser.OPERATORS, "keywords": parser.KEYWORDS}


@dataclass
class Rows:
    """A collected result."""

    columns: list[str]
    rows: list[list]
    stats: dict = field(default_factory=dict)


class Engine:
    """Runs queries over a catalog under a schema; both are given, none is global."""

    def __init__(self, catalog: Catalog, schema: Schema, limits: Limits | None = None):
        self.catalog, self.schema, self.limits = catalog, schema, limits or Limits.from_environment()

    def parse(self, text: str, earliest: int = 0, latest: int = 0) -> Query:
        self.limits.check("text_bytes", len(text.encode()), "bytes of query text")
        text = expand(text, self.schema.knowledge)
        bases = [self.schema.default, *self.schema.alternatives]
        return parser.Parser([b.keyword for b in bases], self.schema.default.keyword, self.schema.metric, self.limits, earliest, latest).parse(text)

    def query(self, text: str, earliest: int = 0, latest: int = 0) -> DataFrame:
        """The result as a lazy DataFrame; bounds are seconds, inclusive, 0 for none."""
        return self.build(self.parse(text, earliest, latest), earliest, latest)

    def build(self, query: Query, earliest: int = 0, latest: int = 0) -> DataFrame:
        leaf = Leaf(self.catalog, self.schema, earliest, latest)
        stages = Stages(self.catalog, lambda sub: self.build(sub, earliest, latest))
        scope = leaf.read(query.base)
        if not isinstance(query.base, MetricBase):
            for stage in self._implied():
                scope = stages.apply(stage, scope)
        for stage in query.stages:
            scope = stages.apply(stage, scope)
        return scope.output()

    def _implied(self) -> list[Stage]:
        """Calculated fields and automatic lookups; invalid definitions are left out."""
        known, out = self.schema.knowledge, []
        for name, text in known.calculated:
            if is_name(name):
                try:
                    out.append(Stage("eval", {"name": name, "tree": expressions.parse(text)}))
                except QueryError:
                    continue
        for table, key, output in known.lookups:
            if is_name(table) and is_name(key) and all(map(is_name, output)):
                out.append(Stage("lookup", {"table": table, "key": key, "output": tuple(output)}))
        return out

    def page(self, text: str, size: int, after: tuple[int, int] | None = None, earliest: int = 0, latest: int = 0) -> DataFrame:
        """The newest `size` rows, or those that come after the row with the (ts, id) `after`.

        Rows are picked by their order, not by an offset, so a later page costs no
        more than the first.
        """
        df = Engine(self.catalog, self.schema.with_cursor_id(), self.limits).query(text, earliest, latest)
        if not {"ts", "id"} <= set(df.columns):
            raise QueryError("pages need ts and id in the result")
        if after is not None:
            ts, id_ = after
            df = df.where((F.col("ts") < ts) | (F.col("ts") == ts) & (F.col("id") < id_))
        return df.orderBy(F.desc("ts"), F.desc("id")).limit(size)

    def masked(self, masks: dict[str, str] | None, salt: str = "") -> Engine:
        """This engine for a caller under masks. None, for a caller whose masks are not known, is refused."""
        if masks is None:
            raise QueryError("a caller's masks have to be known, if there are none as an empty set")
        return Engine(self.catalog, self.schema.with_masks({**self.schema.masks, **masks}, salt or self.schema.salt), self.limits)

    def within(self, env: str | None) -> Engine:
        """This engine with tables of one environment only (None: of all)."""
        return Engine(self.catalog, self.schema.with_env(env), self.limits)

    def collect(self, text: str, earliest: int = 0, latest: int = 0, limit: int = 10_000, budget_ms: int = 0, tag: str | None = None) -> Rows:
        """The first `limit` rows, with whether there are more.

        budget_ms: the query's jobs are cancelled after so long (0: never). tag: a
        name by which cancel() ends them from another thread. Both raise QueryError.
        """
        began = time.monotonic()
        df = self.query(text, earliest, latest)
        jobs, own = df.sparkSession.sparkContext, f"sluice-{uuid.uuid4().hex}"
        tags = [own, *([tag] if tag else [])]
        done = threading.Event()

        def watch() -> None:  # again and again, since a query has several jobs
            done.wait(budget_ms / 1000)
            while not done.wait(0.2):
                jobs.cancelJobsWithTag(own)

        for t in tags:
            jobs.addJobTag(t)
        if budget_ms > 0:
            threading.Thread(target=watch, daemon=True).start()
        try:
            rows = df.limit(limit + 1).collect()
        except Exception as why:
            if "cancel" in str(why).lower():
                spent = int(1000 * (time.monotonic() - began))
                raise QueryError(f"the query was cancelled after {spent} ms" + (f" (budget: {budget_ms} ms)" if 0 < budget_ms <= spent else "")) from why
            raise
        finally:
            done.set()
            for t in tags:
                jobs.removeJobTag(t)
        stats = {"elapsed_ms": int(1000 * (time.monotonic() - began)), "rows": min(len(rows), limit), "truncated": len(rows) > limit}
        return Rows(df.columns, [list(r) for r in rows[:limit]], stats)

    @staticmethod
    def cancel(spark: SparkSession, tag: str) -> None:
        """Ends the jobs that run under a tag now."""
        spark.sparkContext.cancelJobsWithTag(tag)
