"""What a dataset holds, as one JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _box(x: Column, y: Column) -> list[Column]:
    return [F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y")]


def _polygon(b: Column) -> Column:
    corner = lambda x, y: F.concat_ws(" ", b[x].cast("string"), b[y].cast("string"))
    ring = F.concat_ws(", ", corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"), corner("min_x", "min_y"))
    return F.concat(F.lit("POLYGON (("), ring, F.lit("))"))


def point_cloud_info(points: DataFrame, projection: str = "") -> DataFrame:
    """(info): type, projection, bounds, number of points and of each class, of a point cloud."""
    total = points.agg(F.struct(F.count(F.lit(1)).alias("count"), *_box(F.col("x"), F.col("y")), F.min("z").alias("min_z"), F.max("z").alias("max_z")).alias("b"))
    classes = points.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("classes"))
    return total.crossJoin(classes).select(F.to_json(F.struct(F.lit("pointcloud").alias("type"), F.lit(projection).alias("projection"), _polygon(F.col("b")).alias("bounds"), F.col("b.count").alias("count"), F.col("b.min_z"), F.col("b.max_z"), "classes")).alias("info"))


def raster_info(raster: DataFrame, spec, projection: str = "") -> DataFrame:
    """(info): type, projection, size, bounds and statistics of the bands, of a raster."""
    from ..operators.raster import stats

    b = spec.bounds
    bands = stats(raster).agg(F.array_sort(F.collect_list(F.struct("band", "min", "max", "mean", "stddev", "count"))).alias("bands"))
    box = f"POLYGON (({b.minx} {b.miny}, {b.maxx} {b.miny}, {b.maxx} {b.maxy}, {b.minx} {b.maxy}, {b.minx} {b.miny}))"
    return bands.select(F.to_json(F.struct(F.lit("raster").alias("type"), F.lit(projection).alias("projection"), F.lit(spec.cols).alias("cols"), F.lit(spec.rows).alias("rows"), F.lit(box).alias("bounds"), "bands")).alias("info"))


def layer_info(features: DataFrame, layer: str = "data", projection: str = "") -> DataFrame:
    """(info): type, projection, number of features and fields, of a vector layer."""
    from .vectors import layer_fields

    fields = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type")) for c, t in layer_fields(features).items()])
    return features.agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct(F.lit("vector").alias("type"), F.lit(layer).alias("layer"), F.lit(projection).alias("projection"), "count", fields.alias("fields"))).alias("info"))
