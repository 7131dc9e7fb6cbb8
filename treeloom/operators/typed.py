"""Typed reads and writes of text, as columns. value is null where there is no node; the default holds only there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^[ \t\r\n\x0b\x0c]*([-+]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+))"
_REAL = r"^[ \t\r\n\x0b\x0c]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def as_string(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def _integer(value: Column, low: int, high: int) -> Column:
    """The leading whole number as decimal(38): base 16 after 0x, else 10; what isn't one is 0; cut to the type's range."""
    sign, hexed, plain = (F.regexp_extract(value, _INTEGER, k) for k in (1, 2, 3))
    short = F.regexp_replace(hexed, "^0+", "")
    of_hex = F.when(F.length(short) > 16, F.lit(str(2**64))).otherwise(F.conv(F.when(short == "", "0").otherwise(short), 16, 10))
    trimmed = F.regexp_replace(plain, "^0+(?=.)", "")
    of_plain = F.when(F.length(trimmed) > 30, F.lit("9" * 30)).otherwise(trimmed)
    size = F.coalesce(F.when(hexed != "", of_hex).when(plain != "", of_plain).otherwise("0").try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    number = F.when(sign == "-", -size).otherwise(size)
    return F.greatest(F.lit(str(low)).cast("decimal(38,0)"), F.least(F.lit(str(high)).cast("decimal(38,0)"), number))


def as_int(value: Column, default: int = 0) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(_integer(value, -(2**31), 2**31 - 1).cast("int"))


def as_llong(value: Column, default: int = 0) -> Column:
    return F.when(value.isNull(), F.lit(default).cast("long")).otherwise(_integer(value, -(2**63), 2**63 - 1).cast("long"))


def as_uint(value: Column, default: int = 0) -> Column:
    """A negative number wraps around."""
    n = _integer(value, -(2**32) + 1, 2**32 - 1)
    return F.when(value.isNull(), F.lit(default).cast("long")).otherwise(F.when(n < 0, n + F.lit(2**32).cast("decimal(38,0)")).otherwise(n).cast("long"))


def as_ullong(value: Column, default: int = 0) -> Column:
    n = _integer(value, -(2**64) + 1, 2**64 - 1)
    return F.when(value.isNull(), F.lit(default).cast("decimal(20,0)")).otherwise(F.when(n < 0, n + F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(n).cast("decimal(20,0)"))


def as_double(value: Column, default: float = 0.0) -> Column:
    """The leading decimal number; 0 without one."""
    return F.when(value.isNull(), F.lit(float(default))).otherwise(F.coalesce(F.regexp_extract(value, _REAL, 1).try_cast("double"), F.lit(0.0)))


def as_float(value: Column, default: float = 0.0) -> Column:
    return as_double(value, default).cast("float")


def as_bool(value: Column, default: bool = False) -> Column:
    """Whether the first character is one of 1, t, T, y, Y."""
    return F.coalesce(F.substring(value, 1, 1).isin("1", "t", "T", "y", "Y"), F.lit(default))


def of_bool(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def of_integer(value: Column) -> Column:
    return value.cast("string")


def of_double(value: Column) -> Column:
    """Six significant digits, without zeros at the end; an exponent of two digits or more below 1e-4 and from 1e6 on."""
    printed = F.format_string("%.5e", value.cast("double"))
    digits, power = F.regexp_replace(F.regexp_extract(printed, "^-?([0-9.]+)e", 1), "\\.?0+$", ""), F.regexp_extract(printed, "e([-+][0-9]+)$", 1)
    fixed = F.element_at(F.array(*[F.format_string(f"%.{n}f", F.abs(value.cast("double"))) for n in range(10)]), F.greatest(F.lit(1), F.least(F.lit(10), 6 - F.coalesce(power.try_cast("int"), F.lit(0)))))
    fixed = F.when(F.contains(fixed, F.lit(".")), F.regexp_replace(fixed, "\\.?0+$", "")).otherwise(fixed)
    sign = F.when(F.startswith(printed, F.lit("-")), "-").otherwise("")
    special = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").when(value == 0, F.concat(sign, F.lit("0")))
    return special.when((power.try_cast("int") < -4) | (power.try_cast("int") >= 6), F.concat(sign, digits, F.lit("e"), power)).otherwise(F.concat(sign, fixed))
