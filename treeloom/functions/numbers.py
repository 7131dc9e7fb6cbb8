"""IEEE-754 and XPath 1.0 conversions as columns. No result is ever null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
_NUMBER = r"^[ \t\r\n]*-?([0-9]+([.][0-9]*)?|[.][0-9]+)[ \t\r\n]*$"
_BIG = float(1 << 52)


def to_number(s: Column) -> Column:
    """String to number: an optional minus and decimal digits between blanks; everything else is NaN."""
    return F.when(s.rlike(_NUMBER), F.coalesce(F.btrim(s, F.lit(" \t\r\n")).try_cast("double"), F.lit(NAN))).otherwise(F.lit(NAN))


def to_text(x: Column) -> Column:
    """Number to string: no exponent, 16 significant digits at most, no zeros at the end; NaN, Infinity, 0."""
    printed = F.format_string("%.15e", F.abs(x))
    digits = F.regexp_replace(F.replace(F.regexp_extract(printed, "^([0-9.]+)e", 1), F.lit("."), F.lit("")), "0+$", "")
    power = F.regexp_extract(printed, "e([-+][0-9]+)$", 1).try_cast("int")
    whole = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), whole))


def truth(x: Column) -> Column:
    """Number to boolean."""
    return (x != 0) & ~F.isnan(x)


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, F.when(b == 0, F.lit(1.0)).otherwise(b))))


def equal(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def unequal(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b) | (a != b)


def compare(op: str, a: Column, b: Column) -> Column:
    """One of < <= > >=; false if either is NaN (the engine itself takes NaN for the greatest number)."""
    test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return ~F.isnan(a) & ~F.isnan(b) & test


def _settled(x: Column) -> Column:
    """NaN, infinities and numbers without a fraction."""
    return F.isnan(x) | (F.abs(x) >= _BIG) | (x == 0)


def floor(x: Column) -> Column:
    return F.when(_settled(x), x).otherwise(F.floor(F.when(_settled(x), F.lit(0.0)).otherwise(x)).cast("double"))


def ceiling(x: Column) -> Column:
    up = F.ceil(F.when(_settled(x), F.lit(0.0)).otherwise(x)).cast("double")
    return F.when(_settled(x), x).when((x > -1) & (x < 0), F.lit(-0.0)).otherwise(up)


def nearest(x: Column) -> Column:
    """floor(x + 0.5)."""
    return floor(x + F.lit(0.5))


def rounded(x: Column) -> Column:
    """nearest, with negative zero from -0.5 to 0."""
    return F.when((x >= -0.5) & (x < 0), F.lit(-0.0)).when(x == 0, x).otherwise(nearest(x))
