"""The eval language's functions and operators as built-in expressions, with SQLite's meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import QueryError
from sluice.functions.values import Value, glob_pattern

STRING, DOUBLE, LONG, BOOL, NULL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.NullType()


def build(tree: tuple, resolve: Callable[[str], Value]) -> Value:
    """The value of an expression tree; names are resolved by resolve."""
    kind = tree[0]
    if kind == "lit":
        v = tree[1]
        return Value(F.lit(v), {str: STRING, int: LONG, float: DOUBLE, bool: BOOL, type(None): NULL}[type(v)])
    if kind == "name":
        return resolve(tree[1])
    if kind == "unary":
        a = build(tree[2], resolve)
        if tree[1] == "not":
            return Value(~truth(a), BOOL)
        return Value(-numeric(a).column if tree[1] == "-" else numeric(a).column, numeric(a).kind)
    if kind == "in":
        a, items = build(tree[2], resolve), [build(t, resolve) for t in tree[3]]
        found = F.lit(False)
        for item in items:
            found = found | _same(a, item)
        return Value(~found if tree[1] else found, BOOL)
    if kind == "between":
        a, low, high = (build(t, resolve) for t in tree[2:])
        found = _ordered(">=", a, low) & _ordered("<=", a, high)
        return Value(~found if tree[1] else found, BOOL)
    if kind == "binary" and tree[1] == "glob":
        if tree[3][0] != "lit":
            raise QueryError("eval: glob needs a literal pattern")
        return glob(build(tree[2], resolve), str(tree[3][1]))
    if kind == "binary":
        return _binary(tree[1], build(tree[2], resolve), build(tree[3], resolve))
    return _call(tree[1], [build(t, resolve) for t in tree[2]])


def truth(v: Value) -> Column:
    """As a condition: a boolean, or a number other than 0."""
    if isinstance(v.kind, T.NullType):
        return F.lit(None).cast("boolean")
    return v.column if isinstance(v.kind, T.BooleanType) else v.number() != 0


def numeric(v: Value) -> Value:
    if isinstance(v.kind, T.NumericType):
        return v
    return Value(v.number(), DOUBLE if not isinstance(v.kind, T.BooleanType) else LONG)


def _ordered(op: str, a: Value, b: Value) -> Column:
    """Numbers compare with text by the text's number; text with text as text."""
    if a.is_text and b.is_text:
        left, right = a.column, b.column
    elif a.is_text or b.is_text or isinstance(a.kind, T.BooleanType) != isinstance(b.kind, T.BooleanType):
        left, right = (a.column, b.column) if NULL in (a.kind, b.kind) else (a.number(), b.number())
    else:
        left, right = a.column, b.column
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _same(a: Value, b: Value) -> Column:
    return _ordered("=", a, b)


def _binary(op: str, a: Value, b: Value) -> Value:
    if op in ("and", "or"):
        return Value(truth(a) & truth(b) if op == "and" else truth(a) | truth(b), BOOL)
    if op == "is":
        same = _same(a, b)
        return Value(F.when(a.column.isNull() | b.column.isNull(), a.column.isNull() & b.column.isNull()).otherwise(F.coalesce(same, F.lit(False))), BOOL)
    if op in ("=", "!=", "<", "<=", ">", ">="):
        return Value(_ordered(op, a, b), BOOL)
    if op == ".":
        return Value(F.concat(a.text(), b.text()), STRING)
    if op == "like":
        return Value(F.call_function("ilike", a.text(), F.replace(b.text(), F.lit("\\"), F.lit("\\\\"))), BOOL)
    whole = a.is_whole and b.is_whole
    x, y = numeric(a).column, numeric(b).column
    if op in "+-*":
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x.cast("long"), y.cast("long")) if whole else {"+": x + y, "-": x - y, "*": x * y}[op]
        return Value(made, LONG if whole else DOUBLE)
    if op == "/":
        if whole:
            return Value(F.when(y != 0, F.call_function("div", x.cast("long"), F.when(y != 0, y).cast("long"))), LONG)
        return Value(F.try_divide(x.cast("double"), y.cast("double")), DOUBLE)
    if op == "%":
        x, y = x.try_cast("long"), y.try_cast("long")
        return Value(F.try_mod(x, y), LONG)
    raise QueryError(f"eval: operator not supported: {op}")


def _common(values: list[Value]) -> tuple[list[Column], T.DataType]:
    """Columns of one type: their own if they share it, numbers if all are, else text."""
    kinds = [v.kind for v in values if not isinstance(v.kind, T.NullType)]
    if not kinds:
        return [v.column.cast("string") for v in values], STRING
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return [v.column.cast("long") for v in values], LONG
    if all(isinstance(k, T.NumericType) for k in kinds):
        return [v.column.cast("double") for v in values], DOUBLE
    if all(isinstance(k, T.BooleanType) for k in kinds):
        return [v.column.cast("boolean") for v in values], BOOL
    return [v.column.cast("string") for v in values], STRING


def _call(name: str, args: list[Value]) -> Value:
    first = args[0]
    if name == "if":
        (a, b), kind = _common(args[1:])
        return Value(F.when(truth(first), a).otherwise(b), kind)
    if name in ("coalesce", "ifnull"):
        columns, kind = _common(args)
        return Value(F.coalesce(*columns), kind)
    if name == "nullif":
        return Value(F.when(F.coalesce(_same(*args), F.lit(False)), None).otherwise(first.column), first.kind)
    if name in ("lower", "upper"):
        return Value(getattr(F, name)(first.text()), STRING)
    if name in ("length", "len"):
        return Value(F.length(first.text()).cast("long"), LONG)
    if name == "abs":
        v = numeric(first)
        return Value(F.abs(v.column), v.kind)
    if name == "round":
        digits = numeric(args[1]).column.try_cast("int") if len(args) > 1 else F.lit(0)
        # Half away from zero, on doubles.
        x, scale = numeric(first).column.cast("double"), F.pow(F.lit(10.0), F.greatest(digits, F.lit(0)))
        return Value(F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale, DOUBLE)
    if name in ("min", "max"):
        columns, kind = _common(args)
        missing = columns[0].isNull()
        for c in columns[1:]:
            missing = missing | c.isNull()
        return Value(F.when(~missing, (F.least if name == "min" else F.greatest)(*columns)), kind)
    if name == "substr":
        return Value(_substr(first.text(), *(numeric(a).column.try_cast("int") for a in args[1:])), STRING)
    if name == "replace":
        a, b, c = (v.text() for v in args)
        return Value(F.when(b == "", a).otherwise(F.replace(a, b, c)), STRING)
    if name == "trim":
        return Value(F.btrim(first.text(), args[1].text()) if len(args) > 1 else F.btrim(first.text()), STRING)
    raise QueryError(f"eval: function not allowed: {name}")


def _substr(text: Column, start: Column, count: Column | None = None) -> Column:
    """Positions from 1; below 0 from the end; a negative count takes what precedes."""
    n = F.length(text)
    begin = F.when(start > 0, start - 1).when(start < 0, n + start).otherwise(F.lit(-1))
    if count is None:
        return F.substring(text, F.greatest(begin, F.lit(0)) + 1, n)
    low = F.when(count >= 0, begin).otherwise(begin + count)
    high = F.when(count >= 0, begin + count).otherwise(begin)
    low, high = F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0))
    return F.when(high > low, F.substring(text, low + 1, high - low)).when(high.isNotNull() & text.isNotNull(), "")


def glob(a: Value, pattern: str) -> Value:
    return Value(a.text().rlike(glob_pattern(pattern)), BOOL)
