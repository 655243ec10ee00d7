"""Column expressions that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What lies between words; words are digits, ASCII letters and everything beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space that is stripped from the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased and all else kept.

    lower() is the fast way where every character is ASCII.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text, lower-cased (A-Z only); none for null.

    Splitting at the gaps is far faster than extracting the words, which copies
    the text for every match.
    """
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, -1), "")
