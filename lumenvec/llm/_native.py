"""Column expressions shared by the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The word separators: space, and tab to carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(value: Column) -> Column:
    """Maximal runs of characters other than the separators."""
    return F.filter(F.split(value, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def lower_ascii(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def without(value: Column, chars: str) -> Column:
    return F.translate(value, chars, "")


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it: a lambda's variable is never replaced by its expression."""
    return F.get(F.transform(F.array(value), f), 0)
