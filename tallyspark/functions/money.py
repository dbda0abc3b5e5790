"""Exact money: minor units, major units and US cents in decimals, halves away from zero.

The fact's own columns are doubles, as its contract has them; these are for amounts that must come out to the cent whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import C, col

#: Largest exponent of a currency; amounts of minor units have at most 18 digits, rates six places.
LARGEST = 6
RATE = "decimal(18,6)"


def _power(exponent: C, sign: int) -> Column:
    """10 to the exponent (or its inverse) as a decimal; null for an exponent out of range."""
    whole = f"decimal({LARGEST + 1},{0 if sign > 0 else LARGEST})"
    found = F.lit(None).cast(whole)
    for e in range(LARGEST, -1, -1):
        found = F.when(col(exponent) == e, F.lit(str(10**e) if sign > 0 else f"{10.0**-e:.{LARGEST}f}").cast(whole)).otherwise(found)
    return found


def _minor(c: C) -> Column:
    return col(c).cast("decimal(18,0)")


def major_of(minor: C, exponent: C) -> Column:
    """The amount in major units, exact."""
    return _minor(minor) * _power(exponent, -1)


def minor_of(major: C, exponent: C) -> Column:
    """Whole minor units of a decimal amount of up to eight places."""
    return F.round(col(major).cast("decimal(26,8)") * _power(exponent, 1), 0).cast("bigint")


def usd_cents(minor: C, exponent: C, rate: C) -> Column:
    """US cents of an amount at a rate of local units per USD. Rounded once, by whole division of exact decimals; null without a positive rate."""
    rate = col(rate).cast(RATE)
    unit = rate * _power(exponent, 1)
    whole = F.call_function("div", F.abs(_minor(minor)) * F.lit(200) + unit, unit * F.lit(2))
    return F.when(rate > 0, F.when(col(minor) < 0, -whole).otherwise(whole))
