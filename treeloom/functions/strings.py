"""XPath 1.0 string functions as columns; characters are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions import numbers as N


def before(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(at > 1, F.substring(a, F.lit(1), at - 1)).otherwise("")


def after(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(F.length(b) == 0, a).when(at > 0, F.substring(a, at + F.length(b), F.length(a))).otherwise("")


def part(s: Column, first: Column, length: Column | None = None) -> Column:
    """substring(): positions are rounded as numbers, out-of-range ones are cut, NaN gives ''."""
    begin = N.nearest(first)
    size = F.length(s).cast("double") + 1
    end = size if length is None else begin + N.nearest(length)
    empty = F.isnan(begin) | (begin >= size)
    if length is not None:
        empty = empty | F.isnan(end) | (begin >= end) | (end <= 1)
    low = F.when(empty | (begin < 1), F.lit(1.0)).otherwise(begin)
    high = F.when(empty, F.lit(1.0)).when(end > size, size).otherwise(end)
    return F.when(empty, "").otherwise(F.substring(s, low.cast("int"), (high - low).cast("int")))


def normalize_space(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, "[ \\t\\r\\n]+", " "), F.lit(" "))


def local_name(name: Column) -> Column:
    return F.regexp_replace(name, "^[^:]*:", "")


def prefix(name: Column) -> Column:
    return F.regexp_extract(name, "^([^:]*):", 1)


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
