"""Where queries find their tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import QueryError


@dataclass(frozen=True)
class Bounded:
    """A table that is read for a range of seconds (inclusive, 0 for no bound).

    read may give rows outside the range, but none inside is missing: it is where
    bounds become conditions on stored columns, which reach files and partitions.
    """

    read: Callable[[int, int], DataFrame]


class Catalog:
    """Named tables; a table is made when it is first asked for."""

    def __init__(self, tables: Mapping[str, DataFrame | Bounded | Callable[[], DataFrame]]):
        self._tables = dict(tables)

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        return cls({n: (lambda n=n: spark.read.parquet(f"{folder}/{n}.parquet")) for n in names})

    def table(self, name: str, earliest: int = 0, latest: int = 0) -> DataFrame:
        if name not in self._tables:
            raise QueryError(f"table not found: {name}")
        found = self._tables[name]
        if isinstance(found, Bounded):
            return found.read(earliest, latest)
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def with_tables(self, **more: DataFrame | Bounded | Callable[[], DataFrame]) -> Catalog:
        return Catalog(self._tables | more)
