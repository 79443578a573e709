"""Number rules that decide parity: rounding, ratios, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: str | Column, places: int = 0) -> Column:
    """Round as Python's ``round`` does: the exact binary value, ties to even.

    ``bround`` works on the shortest decimal form instead, so it takes 0.295,
    whose binary value is a little less, for a tie. Here, where the product
    with ``10 ** places`` looks like a tie, its rounding error decides: the
    value is split in two halves whose products with the scale are exact. Up
    to seven places; infinities and NaN stay as they are.
    """
    if not 0 <= places <= 7:  # beyond that the scale has more bits than a half
        raise ValueError("places must be from 0 to 7")
    x, scale = _col(c).cast("double"), float(10 ** places)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper 26 bits
    error = (high * scale - product) + (x - high) * scale
    tie = F.abs(product - F.rint(product)) == 0.5
    return F.rint(F.when(tie, product + F.signum(error) * 0.25).otherwise(product)) / F.lit(scale)


def round_half_up(c: str | Column, places: int = 0) -> Column:
    """``floor(x * 10^k + 0.5) / 10^k``: the same bits in Spark and in SQL engines.

    Used where results are compared against another engine, whose rounding of
    binary ties differs from Spark's.
    """
    scale = 10 ** places
    return F.floor(_col(c) * scale + F.lit(0.5)) / F.lit(scale)


def rounder(mode: str):
    """Pick a rounding function by name: ``even`` (default parity) or ``half_up``."""
    if mode == "even":
        return round_even
    if mode == "half_up":
        return round_half_up
    if mode == "none":
        return lambda c, places=0: _col(c)
    raise ValueError(f"unknown rounding mode {mode!r}")


def percent(numerator: str | Column, denominator: str | Column) -> Column:
    """``numerator / denominator * 100``; null (not an error) when the denominator is 0."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator)) * 100


def complement(c: str | Column, total: str | Column | float = 100.0) -> Column:
    """``total - x`` (rejected = total - approved; 100 - rate)."""
    tot = total if isinstance(total, Column) else (F.col(total) if isinstance(total, str) else F.lit(total))
    return tot - _col(c)


def parse_int_prefix(c: str | Column) -> Column:
    """B11, like JavaScript ``parseInt``: leading whitespace, sign, digits; else null.

    Digits after a decimal point are dropped, so the value truncates toward zero.
    """
    m = F.regexp_extract(F.ltrim(_col(c)), r"^([+-]?[0-9]+)", 1)
    return F.when(m != "", m.try_cast("long"))


def parse_float_prefix(c: str | Column) -> Column:
    """B11, like JavaScript ``parseFloat``: the longest numeric prefix, else null."""
    m = F.regexp_extract(
        F.ltrim(_col(c)), r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1
    )
    return F.when(m != "", m.try_cast("double"))


def nan_to_null(c: str | Column) -> Column:
    """Spark aggregates do not skip NaN; turn NaN into null first."""
    col = _col(c)
    return F.when(~F.isnan(col), col)
