"""Money arithmetic. All rounding is half-up and exact: nothing goes through a double."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centsible.schemas import TOTAL


COUNT = T.DecimalType(24, 0)


def ten_thousandths(part: Column, whole: Column) -> Column:
    """``part / whole`` rounded half-up to 4 decimals, as a count of 1/10000; 0 when whole is 0.

    Decimal division would first round to the type's own scale and so round twice. Here the
    whole quotient and the remainder are divided as integers, the latter after half a divisor
    is added. ``whole`` must not be negative.
    """
    part, whole = part.cast(TOTAL), whole.cast(TOTAL)
    size = F.abs(part)
    divisor = F.nullif(whole, F.lit(0).cast(TOTAL))  # safe in the branch that is not taken
    quotient = F.call_function("div", size, divisor).cast(COUNT)
    remainder = (size % divisor).cast(TOTAL)
    rest = F.call_function("div", remainder * 20000 + whole, divisor * 2).cast(COUNT)
    count = (quotient * 10000 + rest).cast(COUNT)
    return F.when(whole == 0, F.lit(0).cast(COUNT)).otherwise(F.when(part < 0, -count).otherwise(count))


def percent(part: Column, whole: Column, scale: int = 2) -> Column:
    """``part / whole`` in percent; the ratio is rounded to 4 decimals first."""
    hundredths = ten_thousandths(part, whole) * F.lit(Decimal("0.01"))
    return hundredths.cast(T.DecimalType(22 + scale, scale))


def direction(change: Column) -> Column:
    return F.when(change > 0, "INCREASE").when(change < 0, "DECREASE").otherwise("FLAT")


def three_significant_digits(value: Column) -> Column:
    """Round half-up to 3 significant digits; sizes below 1 keep two decimals."""
    size = F.abs(value)
    rounded = F.when(size < 10, F.round(value, 2)).when(size < 100, F.round(value, 1))
    for digits in range(3, 15):
        rounded = rounded.when(size < 10**digits, F.round(value, 3 - digits))
    return rounded.cast("decimal(19,4)")
