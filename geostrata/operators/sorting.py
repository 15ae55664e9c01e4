"""Orders of points: by row, along a z-curve, by height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(points: DataFrame, x0: float, y0: float, sx: float, sy: float) -> DataFrame:
    """x and y as whole steps from an origin, in u and v."""
    return points.withColumns({"u": F.floor((F.col("x") - x0) / sx).cast("long"), "v": F.floor((F.col("y") - y0) / sy).cast("long")})


def morton(u: Column, v: Column, bits: int = 15) -> Column:
    """Bits of u on even and of v on odd places; both are below 2^bits, at most 31."""

    def spread(c: Column) -> Column:
        c = c.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            if shift < bits:
                c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(u).bitwiseOR(F.shiftleft(spread(v), 1))


def by_row(points: DataFrame) -> DataFrame:
    return points.orderBy("y", "x")


def by_point(points: DataFrame) -> DataFrame:
    return points.orderBy("x", "y")


def by_height(points: DataFrame) -> DataFrame:
    return points.orderBy("z")


def by_morton(points: DataFrame, x0: float, y0: float, step: float, partitions: int, bits: int = 31) -> DataFrame:
    """Points in partitions that are ranges of the z-curve, each in its order, with the curve's place in morton."""
    keyed = scaled(points, x0, y0, step, step).withColumn("morton", morton(F.col("u"), F.col("v"), bits)).drop("u", "v")
    return keyed.repartitionByRange(partitions, "morton").sortWithinPartitions("morton")
