"""Scalar column builders with the null, NaN and zero-divisor rules the engine relies on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sentinel of an absent fixed-point price, and the price scale.
NO_PRICE = 9223372036854775807
PRICE_SCALE = 1e-9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scaled_price(c: str | Column) -> Column:
    """Fixed-point to double; the sentinel, compared as an integer, is null."""
    c = col(c).cast("long")
    return F.when(c != F.lit(NO_PRICE), c.cast("double") * F.lit(PRICE_SCALE))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0 (ANSI mode raises otherwise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp; null stays null, as greatest and least alone would skip it."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def sum_of(columns: Iterable[str | Column]) -> Column:
    """Sum across columns in which a null counts as 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(col(c), F.lit(0.0))
    return total


def repaired(c: str | Column, default: float = 0.0) -> Column:
    """Null and NaN to a default."""
    return F.coalesce(F.nanvl(col(c), F.lit(float(default))), F.lit(float(default)))


def finite_or(c: str | Column, nan: float = 0.0, high: float = 0.0, low: float = 0.0) -> Column:
    """Replace null and NaN, plus and minus infinity."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), F.lit(float(nan))).when(c == F.lit(float("inf")), F.lit(float(high))).when(c == F.lit(float("-inf")), F.lit(float(low))).otherwise(c)


def not_null(columns: Iterable[str]) -> Column:
    """A predicate: none of the columns is null (NaN is let through, unlike dropna)."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Round half up in double arithmetic; the same steps give the same bits in any engine."""
    scale = F.lit(float(10**digits))
    return F.floor(col(c) * scale + F.lit(0.5)).cast("double") / scale


def seconds_of_day(micros: str | Column) -> Column:
    return F.pmod(F.floor(col(micros) / F.lit(1_000_000)), F.lit(86400))
