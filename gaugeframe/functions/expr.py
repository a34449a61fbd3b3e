"""Column expressions of the engine: number handling, scores, ranks and sort keys. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def compare(op: str, left: Column, right: Column) -> Column:
    return COMPARE[op](left, right)


def trunc2(x: Column) -> Column:
    """Two decimals, cut toward zero."""
    return F.signum(x) * F.floor(F.abs(x) * 100) / 100


def tenths_text(x: Column) -> Column:
    """A number with one decimal, rounded by its exact binary value (half to even)."""
    whole = F.floor(x)
    return F.format_string("%.1f", whole + F.bround((x - whole) * 10, 0) / 10)


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def ratio(current: Column, base: Column) -> Column:
    """Relative change; 0 where equal, 1 from a base of 0."""
    return F.when(current == base, 0.0).when(base == 0, 1.0).otherwise((current - base) / F.nullif(base, F.lit(0.0)))


def finding_score(value: Column, threshold: Column, base: Column) -> Column:
    """A finding's score: its base times how far the value is from the threshold, either way."""
    far = F.try_divide(value, threshold)
    far = F.when(far < 1, F.try_divide(F.lit(1.0), far)).otherwise(far)
    return F.when(threshold == 0, F.when(value < 1, base).otherwise((value - 1) * base)).when(value == 0, base * 2).otherwise(far * base)


def short(x: Column) -> Column:
    """A number cut to two decimals, without zeros at its end."""
    return F.regexp_replace(F.format_string("%.2f", trunc2(x)), r"\.?0+$", "")


def percent_text(x: Column) -> Column:
    size = F.concat(short(F.abs(x) * 100), F.lit("%"))
    return F.when(x > 0, F.concat(size, F.lit(" greater than"))).when(x < 0, F.concat(size, F.lit(" less than"))).otherwise("equal to")


def number_text(x: Column) -> Column:
    """A number with a unit of thousands; negative numbers are never scaled."""
    out = F.when(F.isnan(x), "NaN")
    for size, unit in ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K")):
        out = out.when(x >= size, F.concat(short(x / size), F.lit(unit)))
    return out.otherwise(short(x))


def nearest_rank(values: Column, q: float) -> Column:
    """Of a sorted array, the element at floor(q x n), counted from 0."""
    return F.get(values, F.floor(F.size(values) * F.lit(q)).cast("int"))


def natural_key(name: Column) -> Column:
    """An array to sort by, in which runs of digits compare as numbers."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))


def seconds_since(ms: Column, start_ms: Column) -> Column:
    """Whole seconds, half up."""
    return F.floor((ms - start_ms + 500) / 1000).cast("long")


def size_in_bytes(amount: Column, unit: Column) -> Column:
    unit = F.lower(F.coalesce(unit, F.lit("")))
    return amount * F.when(unit == "kb", 1 << 10).when(unit == "mb", 1 << 20).when(unit == "gb", 1 << 30).otherwise(1).cast("long")
