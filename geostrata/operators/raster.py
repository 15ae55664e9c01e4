"""Raster algebra over cells (band, row, col, value). A null value, like a missing row, is nodata."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SPARK_TYPES, GridSpec


def clean(raster: DataFrame, nodata: float | None = None) -> DataFrame:
    """NaN and the sentinel as null."""
    v = F.col("value")
    bad = F.isnan(v) if nodata is None else F.isnan(v) | (v == nodata)
    return raster.withColumn("value", F.when(~bad, v))


def stats(raster: DataFrame) -> DataFrame:
    """(band, min, max, mean, sum, count, variance, stddev): population statistics of each band, nodata skipped."""
    v = F.col("value")
    return raster.where(v.isNotNull()).groupBy("band").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.count(v).alias("count"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stddev"))


def _with_stats(raster: DataFrame) -> DataFrame:
    # one row for each band; a raster has few, but the join works for any number
    held = stats(raster).select("band", "min", "max", "mean", "stddev")
    return raster.join(held, "band", "left")


def z_score(raster: DataFrame) -> DataFrame:
    """(value - mean) / population deviation by band; null without spread."""
    return _with_stats(raster).select("band", "row", "col", F.try_divide(F.col("value") - F.col("mean"), F.col("stddev")).alias("value"))


def log_normalise(raster: DataFrame) -> DataFrame:
    """ln(1 + (e - 1) (value - min) / (max - min)) by band; null without spread."""
    part = F.try_divide(F.col("value") - F.col("min"), F.col("max") - F.col("min"))
    return _with_stats(raster).select("band", "row", "col", F.log(1 + (math.e - 1) * part).alias("value"))


def fill(raster: DataFrame, value: float) -> DataFrame:
    return raster.withColumn("value", F.lit(float(value)))


def convert(raster: DataFrame, kind: str) -> DataFrame:
    """Values in the type of a band. A value that the type can't hold is null."""
    v = F.col("value")
    limits = {"UInt32": (0, 2**32 - 1), "UInt16": (0, 2**16 - 1), "Byte": (0, 255), "Int32": (-(2**31), 2**31 - 1), "Int16": (-(2**15), 2**15 - 1)}
    if kind in limits:
        low, high = limits[kind]
        v = F.when((v > low - 1) & (v < high + 1), v)
    return raster.withColumn("value", v.cast(SPARK_TYPES[kind]))


def row_of(raster: DataFrame, row: int) -> DataFrame:
    return raster.where(F.col("row") == row)


def col_of(raster: DataFrame, col: int) -> DataFrame:
    return raster.where(F.col("col") == col)


def set_where(raster: DataFrame, where: Column, value: Column | float) -> DataFrame:
    return raster.withColumn("value", F.when(where, value).otherwise(F.col("value")))


def window(raster: DataFrame, spec: GridSpec, col: int, row: int, cols: int, rows: int, outside: float | None = None) -> DataFrame:
    """All cells of a sub-rectangle; those without data are null and those outside the raster have the given value."""
    spark = raster.sparkSession
    bands = raster.select("band").distinct()
    grid = spark.range(cols * rows).select((F.col("id") / cols).cast("int").alias("_r"), (F.col("id") % cols).cast("int").alias("_c"))
    grid = bands.join(grid).select("band", (F.col("_r") + row).alias("row"), (F.col("_c") + col).alias("col"))
    part = raster.where(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))
    met = grid.join(part, ["band", "row", "col"], "left")
    return met if outside is None else met.withColumn("value", F.when(spec.has(F.col("col"), F.col("row")), F.col("value")).otherwise(F.lit(float(outside))))


def copy_block(target: DataFrame, source: DataFrame, from_col: int, from_row: int, cols: int, rows: int, to_col: int, to_row: int, spec: GridSpec) -> DataFrame:
    """target with a block of source written over it, clamped to target's frame; nodata of the source writes nothing."""
    block = source.where(F.col("value").isNotNull() & F.col("row").between(from_row, from_row + rows - 1) & F.col("col").between(from_col, from_col + cols - 1))
    moved = block.select("band", (F.col("row") - from_row + to_row).alias("row"), (F.col("col") - from_col + to_col).alias("col"), F.col("value").alias("_new")).where(spec.has(F.col("col"), F.col("row")))
    return target.join(moved, ["band", "row", "col"], "full").select("band", "row", "col", F.coalesce("_new", "value").alias("value"))


def tiles(raster: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Each cell with its tile, and copies in the tiles whose halo it is in: (tile_row, tile_col, own, band, row, col, value)."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / size).cast("int"), F.floor((F.col(c) + halo) / size).cast("int")))
    spread = raster.withColumn("tile_row", span("row")).withColumn("tile_col", span("col")).where("tile_row >= 0 and tile_col >= 0")
    own = (F.floor(F.col("row") / size) == F.col("tile_row")) & (F.floor(F.col("col") / size) == F.col("tile_col"))
    return spread.withColumn("own", own)


def stack(rasters: list[tuple[GridSpec, DataFrame]]) -> tuple[GridSpec, DataFrame]:
    """Single bands of one frame as the bands 1 to n of one raster."""
    from dataclasses import replace

    first = rasters[0][0]
    for spec, _ in rasters:
        if (spec.cols, spec.rows, spec.kind, spec.tlx, spec.tly, spec.res_x, spec.res_y) != (first.cols, first.rows, first.kind, first.tlx, first.tly, first.res_x, first.res_y):
            raise ValueError("bands differ in size, type or transform")
    held = [r.select(F.lit(i).alias("band"), "row", "col", "value") for i, (_, r) in enumerate(rasters, 1)]
    return replace(first, bands=len(rasters)), reduce(DataFrame.unionByName, held)


def mosaic(rasters: list[DataFrame]) -> DataFrame:
    """One raster of several: of a cell that several have, the value of the first that has data."""
    tagged = reduce(DataFrame.unionByName, [r.where(F.col("value").isNotNull()).select("band", "row", "col", "value", F.lit(i).alias("_order")) for i, r in enumerate(rasters)])
    return tagged.groupBy("band", "row", "col").agg(F.min_by("value", "_order").alias("value"))


def draw_line(raster: DataFrame, spec: GridSpec, x0: int, y0: int, x1: int, y1: int, value: float) -> DataFrame:
    """raster with a line of cells between two cells, where value is greater than what is there."""
    steps = max(abs(x1 - x0), abs(y1 - y0), 1)
    spark = raster.sparkSession
    at = spark.range(steps + 1).select(F.floor(F.lit(x0) + F.col("id") * ((x1 - x0) / steps) + 0.5).cast("int").alias("col"), F.floor(F.lit(y0) + F.col("id") * ((y1 - y0) / steps) + 0.5).cast("int").alias("row"))
    line = at.where(spec.has(F.col("col"), F.col("row"))).distinct().join(raster.select("band").distinct()).withColumn("_line", F.lit(float(value)))
    return raster.join(line, ["band", "row", "col"], "full").select("band", "row", "col", F.greatest("value", "_line").alias("value"))


def runs(raster: DataFrame) -> DataFrame:
    """(band, row, first, last, value): runs of consecutive columns of equal value in a row; nodata breaks a run."""
    w = Window.partitionBy("band", "row").orderBy("col")
    held = raster.where(F.col("value").isNotNull())
    begins = (F.lag("col").over(w) == F.col("col") - 1) & (F.lag("value").over(w) == F.col("value"))
    marked = held.withColumn("_new", F.when(F.coalesce(begins, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy("band", "row", "_run").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.first("value").alias("value")).drop("_run")
