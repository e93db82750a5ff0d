"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space class used for all character counts and trims (Java regex syntax).
WS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def body_chars(x: Column) -> Column:
    """Code points without white space; null counts 0."""
    return F.coalesce(F.length(F.regexp_replace(x, WS, "")), F.lit(0))


def clean_ref(x: Column) -> Column:
    """A reference without blanks or tabs around it; blank or null is no reference."""
    t = F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")
    return F.when(t != "", t)


def moment(x: Column) -> Column:
    """Time of either stored text format as timestamp without zone; anything else is null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(x), "T", " "), "Z$", "")
    return t.try_cast("timestamp_ntz")


def address_array(address: Column) -> Column:
    return F.transform(F.split(address, "-"), lambda p: p.cast("int"))


def address_key(address: Column) -> Column:
    """Zero-padded sort key: its binary order is document order."""
    return F.array_join(F.transform(F.split(address, "-"), lambda p: F.lpad(p, 10, "0")), "-")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
