"""Means that do not depend on summation order.

Item values are counted in a unit that divides every mean over up to 20 runs and every panel
of up to three judges on four dimensions, so their sums are exact integers. Other values are
rounded to the unit in means (to 2e-9), and to the fine unit in the bootstrap, where ties at zero
are decided by one tolerance for all numbers of runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 232_792_560  # lcm(1..20)
FINE = 1 << 16      # fine units in a unit


def in_units(value: Column) -> Column:
    return F.round(value * UNIT).cast("bigint")


def in_fine_units(value: Column) -> Column:
    return F.round(value * float(UNIT * FINE)).cast("bigint")


def exact_mean(value: Column, scale: float = 1.0) -> Column:
    """Mean of a column that lies between 0 and ``scale``; null without values."""
    total = F.sum(in_units(value / scale if scale != 1.0 else value))
    mean = F.try_divide(total, F.count(value)) / UNIT
    return mean * scale if scale != 1.0 else mean
