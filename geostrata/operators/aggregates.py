"""Aggregates of the points of a cell, as Spark aggregate expressions. Each takes the filtered value column.

Values that a filter drops are null, so one pass serves aggregates with filters of their own: pass
F.when(filter, F.col("z")).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(z: Column) -> Column:
    return F.count(z)


def variance(z: Column, bias: int = -1) -> Column:
    """Sum of squares over n + bias; null for a single value with bias -1."""
    return F.var_samp(z) if bias == -1 else F.var_pop(z)


def stddev(z: Column, bias: int = -1) -> Column:
    return F.stddev_samp(z) if bias == -1 else F.stddev_pop(z)


def skewness(z: Column) -> Column:
    """Third central moment over the cube of the sample deviation; null for fewer than two values or no spread."""
    n = F.count(z).cast("double")
    return F.when(F.stddev_samp(z) > 0, F.skewness(z) * F.pow((n - 1) / n, F.lit(1.5)))


def kurtosis(z: Column) -> Column:
    """Fourth central moment over the fourth power of the sample deviation, less 3; null for fewer than two values or no spread."""
    n = F.count(z).cast("double")
    return F.when(F.stddev_samp(z) > 0, (F.kurtosis(z) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3)


def variation(z: Column) -> Column:
    """Sample deviation over mean; null for a mean of 0."""
    return F.try_divide(F.stddev_samp(z), F.avg(z))


def percentile(z: Column, p: float) -> Column:
    """The value at place trunc((n - 1) p) of the sorted values, without interpolation. p may be 0 and 1.

    Gathers the cell's values in one row; for groups without a size bound use gridding.ranked_percentiles.
    """
    values = F.sort_array(F.collect_list(z))
    return F.when(F.count(z) > 0, F.try_element_at(values, ((F.count(z) - 1) * F.lit(float(p))).cast("int") + 1))


def median(z: Column) -> Column:
    return percentile(z, 0.5)


def quartile(z: Column, n: int) -> Column:
    return percentile(z, n / 4)


def decile(z: Column, n: int) -> Column:
    return percentile(z, n / 10)


def idw(z: Column, distance2: Column, exponent: float = 2.0) -> Column:
    """Inverse distance weighting with (1 / squared distance) to the exponent, that is power 4 of the distance for 2; a value at distance 0 is the result."""
    weight = F.when(distance2 > 0, F.pow(1 / F.when(distance2 > 0, distance2), F.lit(exponent)))
    return F.coalesce(F.max(F.when(distance2 == 0, z)), F.sum(weight * z) / F.sum(F.when(z.isNotNull(), weight)))


def density(all_points: Column, z: Column, radius: float) -> Column:
    """All points over the area of the circle; null if the filter leaves none."""
    return F.when(F.count(z) > 0, F.count(all_points) / (math.pi * radius * radius))


def gap_fraction(all_points: Column, above: Column) -> Column:
    """1 less the share of points that pass the threshold; 1 for no points."""
    return F.when(F.count(all_points) == 0, 1.0).otherwise(1 - F.count(above) / F.count(all_points))


def l_moments(rank: Column, n: Column, z: Column) -> dict[str, Column]:
    """l1 to l4 and the ratios t3 and t4, of values with their 1-based rank and number. A moment of order k needs k values.

    Sums over order statistics with binomials in closed form; the fourth divides by C(n, 4).
    """
    r, m = rank.cast("double"), n.cast("double")

    def comb(a: Column, k: int) -> Column:
        product = F.lit(1.0)
        for i in range(k):
            product = product * (a - i)
        return product / math.factorial(k)

    low1, low2, low3 = r - 1, comb(r - 1, 2), comb(r - 1, 3)
    up1, up2, up3 = m - r, comb(m - r, 2), comb(m - r, 3)
    size = F.max(m)

    def moment(k: int, weight: Column) -> Column:
        return F.when(size >= k, F.sum(weight * z) / comb(size, k) / k)

    l1 = F.avg(z)
    l2 = moment(2, low1 - up1)
    l3 = moment(3, low2 - 2 * low1 * up1 + up2)
    l4 = moment(4, low3 - 3 * low2 * up1 + 3 * low1 * up2 - up3)
    return {"l1": l1, "l2": l2, "l3": l3, "l4": l4, "t3": F.try_divide(l3, l2), "t4": F.try_divide(l4, l2)}


def height_quantiles(z: Column, bands: int = 20) -> Column:
    """bands + 1 heights: the least value, values interpolated at ranks (b / bands) (n + 1), and the largest. A place beyond the ends is the end."""
    values = F.sort_array(F.collect_list(z))
    n = F.count(z)

    def at(b: int) -> Column:
        rank = F.lit(b / bands) * (n + 1)
        low = F.greatest(F.lit(1), F.least(n.cast("int"), F.floor(rank).cast("int")))
        high = F.least(n.cast("int"), low + 1)
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rank - low))
        return F.try_element_at(values, low) + part * (F.try_element_at(values, high) - F.try_element_at(values, low))

    inner = [at(b) for b in range(1, bands)]
    return F.when(n > 0, F.array(F.min(z), *inner, F.max(z)))


def canopy_shares(h: Column, top: Column, threshold: float, bands: int = 20) -> Column:
    """Of each of bands + 1 heights from the threshold to the top, the share of all values above it."""
    above = [F.count(F.when(h > F.lit(threshold) + (top - threshold) * F.lit(b / bands), 1)) / F.count(F.lit(1)) for b in range(bands + 1)]
    return F.array(*above)
