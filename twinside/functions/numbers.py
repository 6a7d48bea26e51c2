"""Numeric rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(c: Column) -> Column:
    """Text to double; what does not parse, and NaN, is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def null_safe_sum(a: Column, b: Column) -> Column:
    """Sum that skips nulls but is null when both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def outcome(own: Column, other: Column) -> Column:
    return F.when(own > other, "W").when(own < other, "L").when(own == other, "D")


def outcome_points(own: Column, other: Column) -> Column:
    return F.when(own > other, 3).when(own < other, 0).when(own == other, 1).cast("bigint")


def finite_from_zero(c: Column) -> Column:
    x = to_number(c)
    return F.when((x >= 0) & (x < float("inf")), x)


def valid_count(c: Column) -> Column:
    """Finite, non-negative whole number, else null."""
    x = finite_from_zero(c)
    return F.when(x % 1 == 0, x)


def sample_class(n: Column) -> Column:
    return F.when(n < 3, "insufficient").when(n < 5, "very_small").when(n < 8, "small").otherwise("usable")


def half_line_below(p: Column) -> Column:
    """Highest half-line strictly below ``p``, at least 0.5."""
    return F.greatest(F.lit(0.5), F.ceil(p).cast("double") - 0.5)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(top, bottom)


def _step(x: Column) -> Column:
    """Distance between neighbouring doubles at ``x`` (normal range)."""
    e = F.greatest(F.floor(F.log2(F.abs(x))).cast("int"), F.lit(-1022))
    # log2 may round up just below a power of two; correct from the exact power.
    e = F.when(F.pow(F.lit(2.0), e) > F.abs(x), e - 1).otherwise(e)
    return F.when(x == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), e - 52))


def near_equal(a: Column, b: Column, steps: int = 4) -> Column:
    """True when two numbers differ by at most a few representable steps."""
    x, y = to_number(a), to_number(b)
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.coalesce(finite & (F.abs(x - y) <= steps * F.greatest(_step(x), _step(y))), F.lit(False))


def same_field(a: Column, b: Column, numeric: bool) -> Column:
    """Field equality where null equals empty text and numbers allow round-trip noise."""
    x, y = blank_text(a), blank_text(b)
    same = F.equal_null(x, y)
    return same | (near_equal(a, b) if numeric else F.lit(False))


def blank_text(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t != "", t)
