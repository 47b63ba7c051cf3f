"""Robust statistics over small collected samples, exact in integers.

A sample is an array of integers, at most a few dozen. Positions (n - 1) * p fall
on quarters, so quartiles are kept in quarter units and never rounded before a
decision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quartile_quarters(sample: Column, quarter: int) -> Column:
    """Four times the linearly interpolated quartile (1, 2 or 3) of an array of integers; null if empty."""
    ordered = F.sort_array(sample)
    place = (F.size(sample) - 1) * quarter
    below = ((place - place % 4) / 4).cast("int")
    low, high = F.get(ordered, below), F.get(ordered, F.least(below + 1, F.size(sample) - 1))
    return F.when(F.size(sample) > 0, 4 * low + (place % 4) * (high - low)).cast("bigint")


def summary(sample: Column) -> Column:
    """struct of n, median4, p25_4, p75_4 and iqr4 (four times each figure)."""
    quarter = lambda q: quartile_quarters(sample, q)
    return F.struct(
        F.size(sample).alias("n"),
        quarter(2).alias("median4"),
        quarter(1).alias("p25_4"),
        quarter(3).alias("p75_4"),
        (quarter(3) - quarter(1)).alias("iqr4"),
    )


def two_places(numerator: Column, denominator: Column) -> Column:
    """Hundredths of a quotient of integers, half up away from zero."""
    sign = F.when(numerator < 0, -1).otherwise(1)
    top = 200 * F.abs(numerator) + denominator
    return (sign * ((top - top % (2 * denominator)) / (2 * denominator)).cast("bigint")).cast("bigint")


def curve_confidence(observed: Column, approximate: Column, iqr4: Column, middle4: Column) -> Column:
    """Hundredths of 0.40 sample + 0.35 provenance + 0.25 stability, half up, with caps of 85 and 65.

    sample: 100 at 12 cases. provenance: 100 observed, 60 approximate. stability:
    100 - 50 * iqr / max(|middle|, 1), within 0..100.
    """
    n = observed + approximate
    floor4 = F.greatest(F.abs(middle4), F.lit(4))
    # Over the common denominator 12 * n * floor4, times 100.
    sample = F.least(F.lit(12), n) * 40 * 100 * n * floor4
    provenance = (observed * 100 + approximate * 60) * 35 * 12 * floor4
    stability = F.greatest(F.lit(0), F.least(100 * floor4, 100 * floor4 - 50 * iqr4)) * 25 * 12 * n
    bottom = 12 * n * floor4
    top = 2 * (sample + provenance + stability) + bottom
    score = ((top - top % (2 * bottom)) / (2 * bottom)).cast("bigint")
    score = F.when(approximate > 0, F.least(score, F.lit(8500))).otherwise(score)
    return F.when(n > 0, F.when(observed == 0, F.least(score, F.lit(6500))).otherwise(score))
