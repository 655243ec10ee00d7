"""Field masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(c: Column, mask: str, salt: str) -> Column:
    """c as a caller with this mask sees it; null stays null."""
    text = c.cast("string")
    if mask == "mask":
        return F.when(c.isNotNull(), F.lit("***"))
    if mask == "partial":
        return F.concat(F.lit("***"), F.right(text, F.lit(4)))
    if mask == "hash":
        return F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256)
    return F.lit(None).cast("string")


def without_keys(bag: Column, keys: list[str]) -> Column:
    """A JSON object without some keys; null where it is no JSON object. Nesting is kept."""
    if not keys:
        return bag
    parsed = F.from_json(F.when(F.try_parse_json(bag).isNotNull(), bag), "map<string,variant>")
    return F.to_json(F.map_filter(parsed, lambda k, _: ~k.isin(*keys)))
