"""Measures: named aggregate columns.

Money columns are doubles with two decimals. They are summed as whole cents, so a
total does not depend on how the rows were split over tasks or on a retried task,
as a sum of doubles would. On bigint this costs no more than a sum of doubles;
sums of decimals take several times as long.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units are summed in two parts, above and below this many bits, so that neither
# overflows a bigint however many rows there are.
_LOW_BITS = 20


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: str | Column) -> Column:
    """A money column in whole cents, as bigint."""
    return F.rint(_col(c) * F.lit(100)).cast("bigint")


def exact_sum(units: Column, scale: int = 2) -> Column:
    """Sum of bigint units of 10^-scale, as a decimal."""
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(38,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    return (high * F.lit(1 << _LOW_BITS) + low) * F.lit(Decimal(1).scaleb(-scale))


def from_cents(c: str | Column) -> Column:
    """Cents as a double amount."""
    return _col(c).cast("double") / F.lit(100.0)


def total(c: str | Column) -> Column:
    """Sum of a money column."""
    return exact_sum(cents(c)).cast("double")


def mean(c: str | Column) -> Column:
    """Average of a money column; null for no rows."""
    return F.try_divide(total(c), F.count(_col(c)).cast("double"))


def rows() -> Column:
    return F.count(F.lit(1))


def net_units() -> Column:
    """Line price after discount, in units of 1/10000."""
    return cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))


def net_total() -> Column:
    """Sum of line prices after discount, as a decimal."""
    return exact_sum(net_units(), 4)


def revenue() -> Column:
    return net_total().cast("double")


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 as double; null where the whole is zero."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
