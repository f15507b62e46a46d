"""Number helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(10,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to(x, digits: int = 4) -> Column:
    """Half-up rounding through DECIMAL, so that ties do not depend on the binary form."""
    return F.round(_c(x).cast("decimal(28,8)"), digits).cast("double")


def fixed_text(x, digits: int) -> Column:
    """A number as text with a fixed count of decimals, rounded half-up."""
    return F.round(_c(x).cast("decimal(28,8)"), digits).cast(f"decimal(28,{digits})").cast("string")


def positive(x) -> Column:
    """The value where it is above zero, else NULL."""
    x = _c(x)
    return F.when(x > 0, x)


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def percent_off(price, reference) -> Column:
    """Percent below ``reference``; NULL unless the reference is positive."""
    ref = positive(_c(reference).cast("double"))
    return (F.lit(1.0) - _c(price).cast("double") / ref) * 100


def mean_of_decimals(x, count=None) -> Column:
    """Mean of a decimal column: exact sum, one division."""
    x = _c(x)
    return F.sum(x).cast("double") / F.nullif(count if count is not None else F.count(x), F.lit(0))
