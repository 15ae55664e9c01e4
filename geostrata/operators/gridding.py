"""Points to cells. Candidate cells of a point are computed, never searched: the join is an equality of cell keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import GridSpec
from . import aggregates as A


def to_cells(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Each point with the one cell that holds it; points outside the grid are dropped."""
    held = points.withColumns({"col": spec.col(F.col("x")), "row": spec.row(F.col("y"))})
    return held.where(spec.has(F.col("col"), F.col("row")) & (F.col("x") >= spec.bounds.minx) & (F.col("y") <= spec.bounds.maxy if spec.res_y < 0 else F.col("y") >= spec.bounds.miny))


def _around(points: DataFrame, spec: GridSpec, reach_x: int, reach_y: int) -> DataFrame:
    col, row = spec.col(F.col("x")), spec.row(F.col("y"))
    span = lambda at, reach, size: F.sequence(F.greatest(F.lit(0), at - reach), F.least(F.lit(size - 1), at + reach))
    inside = (col + reach_x >= 0) & (col - reach_x < spec.cols) & (row + reach_y >= 0) & (row - reach_y < spec.rows)
    spread = points.where(inside).withColumn("col", F.explode(span(col, reach_x, spec.cols)))
    return spread.withColumn("row", F.explode(span(row, reach_y, spec.rows)))


def within_radius(points: DataFrame, spec: GridSpec, radius: float | None = None) -> DataFrame:
    """Each point with every cell whose middle is within the closed radius, as col, row and d2, the squared distance.

    Without a radius it is half the diagonal of a cell; with radius 0 a point belongs to each closed cell that holds it, so
    that a point on an edge counts in all cells that share it.
    """
    x, y = F.col("x"), F.col("y")
    d2 = F.pow(x - spec.x(F.col("col")), 2) + F.pow(y - spec.y(F.col("row")), 2)
    if radius == 0:
        near = _around(points, spec, 1, 1).withColumn("d2", d2)
        return near.where((F.abs(x - spec.x(F.col("col"))) <= abs(spec.res_x) / 2) & (F.abs(y - spec.y(F.col("row"))) <= abs(spec.res_y) / 2))
    radius = spec.half_diagonal if radius is None else radius
    near = _around(points, spec, math.ceil(radius / abs(spec.res_x)), math.ceil(radius / abs(spec.res_y))).withColumn("d2", d2)
    return near.where(F.col("d2") <= radius * radius)


def annulus(points: DataFrame, spec: GridSpec, inside: float, outside: float) -> DataFrame:
    """Cells whose middle is more than inside and at most outside away."""
    return within_radius(points, spec, outside).where(F.col("d2") > inside * inside)


def rasterize(points: DataFrame, spec: GridSpec, computers: dict[str, Column], radius: float | None = None, prefilter: Column | None = None, keep: Column | None = None, by: tuple[str, ...] = (), least: int | None = None) -> DataFrame:
    """One row for each cell with points: (by, row, col, count, computers).

    prefilter drops points before the cells are formed; keep drops them from the values alone, so aggregates of all
    points still see them. least drops cells whose kept points are fewer. A computer that has nothing to compute gives
    null. One shuffle: the partial aggregates are made where the points lie.
    """
    held = points if prefilter is None else points.where(prefilter)
    cells = within_radius(held, spec, radius)
    kept = F.lit(True) if keep is None else keep
    out = cells.groupBy(*by, "row", "col").agg(F.count(F.when(kept, F.col("x"))).alias("count"), *[c.alias(n) for n, c in computers.items()])
    return out if least is None else out.where(F.col("count") >= least)


def fill_empty(cells: DataFrame, spec: GridSpec, values: dict[str, float | int]) -> DataFrame:
    """All cells of the grid, with values in the columns of those that have no row."""
    spark = cells.sparkSession
    grid = spark.range(spec.rows * spec.cols).select((F.col("id") / spec.cols).cast("int").alias("row"), (F.col("id") % spec.cols).cast("int").alias("col"))
    return grid.join(cells, ["row", "col"], "left").fillna(values)


def point_density(file_stats: DataFrame, res: float, radius: float) -> DataFrame:
    """Expected points of a cell: 1.5 times the mean over files of count / (area / res^2), times the circle's share of cells."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    share = math.pi * radius * radius / (res * res) if radius > 0 else 1.0
    return file_stats.where(area > 0).agg((F.avg(F.col("point_count") / (area / (res * res))) * (1.5 * share)).alias("density"))


def biometrics(heights: DataFrame, cell: list[str], height: str, key: str, threshold: float, bands: int = 20) -> DataFrame:
    """(cell, rugosity, gap, p85, l1 to l4, t3, t4, lhq, ccf): the forest measures of the heights of each cell, 7 + 2 (bands + 1) numbers.

    All but gap and ccf are of the heights at or above the threshold. Ranks, numbers and tops of a cell are window
    functions over it, so a cell is a bounded piece of ground.
    """
    by = Window.partitionBy(*cell)
    tall = F.col(height) >= threshold
    held = heights.select(*cell, F.col(height).alias("_h"), tall.alias("_tall"), key)
    ranked = held.withColumns({"_top": F.max("_h").over(by), "_n": F.count(F.when(F.col("_tall"), 1)).over(by), "_r": F.row_number().over(Window.partitionBy(*cell, "_tall").orderBy("_h", key))})
    h = F.when(F.col("_tall"), F.col("_h"))
    moments = A.l_moments(F.when(F.col("_tall"), F.col("_r")), F.when(F.col("_tall"), F.col("_n")), h)
    return ranked.groupBy(*cell).agg(F.stddev_samp(h).alias("rugosity"), A.gap_fraction(F.col("_h"), h).alias("gap"), A.percentile(h, 0.85).alias("p85"), *[m.alias(n) for n, m in moments.items()], A.height_quantiles(h, bands).alias("lhq"), A.canopy_shares(F.col("_h"), F.col("_top"), threshold, bands).alias("ccf"))


def ranked_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, shares): as aggregates.percentile, by ranks of a sort that can spill, for groups of any size."""
    by = Window.partitionBy(*keys)
    held = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ranked = held.withColumns({"_r": F.row_number().over(by.orderBy("_v")), "_n": F.count(F.lit(1)).over(by)})
    at = lambda p: F.max(F.when(F.col("_r") == ((F.col("_n") - 1) * F.lit(float(p))).cast("int") + 1, F.col("_v")))
    return ranked.groupBy(*keys).agg(*[at(p).alias(n) for n, p in shares.items()])
