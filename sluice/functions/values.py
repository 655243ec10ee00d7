"""Values of fields whose type the language does not declare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from sluice.errors import QueryError
from sluice.plans.limits import LIST_CHARS
from sluice.plans.nodes import Aggregate

TEXT = (T.StringType, T.VarcharType, T.CharType)


class Value:
    """A column with its type; bag: it comes out of a JSON bag."""

    def __init__(self, column: Column, kind: T.DataType, bag: bool = False):
        self.column, self.kind, self.bag = column, kind, bag

    @property
    def is_text(self) -> bool:
        return isinstance(self.kind, TEXT)

    @property
    def is_whole(self) -> bool:
        return isinstance(self.kind, T.IntegralType)

    def number(self) -> Column:
        """As a number; text that is none is null."""
        if isinstance(self.kind, T.NumericType):
            return self.column
        if isinstance(self.kind, T.BooleanType):
            return self.column.cast("int")
        return self.column.cast("string").try_cast("double")

    def text(self) -> Column:
        return self.column if self.is_text else self.column.cast("string")


def number(text: str) -> Column:
    return F.lit(float(text) if "." in text or abs(int(text)) >= 1 << 63 else int(text))


def like_pattern(glob: str) -> str:
    """A glob as a LIKE pattern: * is any text; _ and % keep their LIKE meaning."""
    return glob.replace("\\", "\\\\").replace("*", "%")


def contains(column: Column, term: str) -> Column:
    """Case-insensitive LIKE '%term%'."""
    return column.ilike("%" + term.replace("\\", "\\\\") + "%")


def glob_pattern(glob: str) -> str:
    """A SQL GLOB as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + inner + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() else c
        i += 1
    return f"(?s)^{out}$"


def compare(op: str, left: Column, right: Column) -> Column:
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def sort_key(v: Value) -> Column:
    """Text of a bag sorts numbers first, by value; all else by itself."""
    if not v.bag:
        return v.column
    n = v.number()
    return F.when(v.column.isNotNull(), F.struct(n.isNull().alias("t"), n.alias("n"), v.column.alias("v")))


def aggregate(a: Aggregate, v: Value | None, over: WindowSpec | None = None) -> Column:
    """The aggregate's column, before its alias; over: for each row of a window, not for a group.

    values and list gather all values here; for groups see stages.joined().
    """
    made = lambda c: c if over is None else c.over(over)
    if v is None:
        return made(F.count(F.lit(1)))
    c = v.column
    if a.function == "count":
        return made(F.count(c))
    if a.function in ("sum", "avg"):
        return made({"sum": F.sum, "avg": F.avg}[a.function](v.number()))
    if a.function in ("min", "max"):
        pick = {"min": F.min, "max": F.max}[a.function]
        return made(pick(sort_key(v)))["v"] if v.bag else made(pick(c))
    if a.function == "dc":
        return F.count_distinct(c) if over is None else F.size(made(F.collect_set(c))).cast("long")
    if a.function in ("values", "list"):
        return listed(made(F.collect_set(v.text()) if a.function == "values" else F.collect_list(v.text())))
    raise QueryError(f"aggregate not supported: {a.function}")


def listed(array: Column) -> Column:
    """Sorted values joined by commas, LIST_CHARS at most; null for none."""
    return F.when(F.size(array) > 0, F.substring(F.array_join(F.array_sort(array), ","), 1, LIST_CHARS))
