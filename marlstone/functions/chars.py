"""Characters of texts as Column expressions. Lengths are bytes; only ASCII is counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First and last bytes of each class; spaces are U+0020 alone, controls are in no class.
CLASSES = {"letters": ("AZ", "az"), "digits": ("09",), "spaces": ("  ",), "punctuation": ("!/", ":@", "[`", "{~")}
NOT_ASCII = r"[^\x00-\x7F]+"


def size(column: str) -> Column:
    return F.octet_length(F.col(column)).cast("bigint")


def kept(column: str, others: str) -> Column:
    """How many characters remain without those that ``others`` matches."""
    return F.length(F.regexp_replace(F.col(column), others, "")).cast("bigint")


def ascii_total(column: str) -> Column:
    return F.coalesce(F.sum(kept(column, NOT_ASCII)), F.lit(0).cast("bigint"))


def in_class(byte: Column, name: str) -> Column:
    """Whether a byte value is in a class."""
    ranges = [byte.between(ord(first), ord(last)) for first, last in CLASSES[name]]
    return reduce(Column.__or__, ranges)
