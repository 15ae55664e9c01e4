"""Queries that send whole tables through the file formats and back. Files go to the session's shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gridding, raster
from ..session import ensure_checkpoint_dir, table
from ..sources import las, rasters, records, vectors
from .cells import _HEIGHTS, THRESHOLD, WITH, _heights
from .registry import GRID, LOW, POINTS, fine, header, low, points, query, steady, steady_sql


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return os.path.join(base.removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}")


@query(f"""with {POINTS} select {steady_sql("x")} as x, {steady_sql("y")} as y, {steady_sql("z")} as z, least(intensity, 65535) as intensity, scan_angle, coalesce(cls, 0) as cls, return_num, num_returns, is_edge, gps_time from pts""")
def source_las(spark: SparkSession, folder: str) -> DataFrame:
    """The points, written to LAS files and read again."""
    out = _folder(spark, "las")
    las.write(points(spark, folder).select("x", "y", "z", "intensity", "scan_angle", "cls", "return_num", "num_returns", "is_edge", "gps_time", F.lit("").alias("file")), out)
    return las.read(spark, out).select(*[steady(F.col(c)).alias(c) for c in "xyz"], "intensity", "scan_angle", "cls", "return_num", "num_returns", "is_edge", "gps_time")


@query(f"""with {POINTS} select count(*) as n, {steady_sql("min(x)")} as min_x, {steady_sql("max(z)")} as max_z from pts""")
def source_las_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Count and bounds of the points by the headers of their LAS files alone."""
    out = _folder(spark, "las")
    las.write(points(spark, folder).select("x", "y", "z", "intensity", "scan_angle", "cls", "return_num", "num_returns", "is_edge", "gps_time", F.lit("").alias("file")), out)
    return las.file_stats(spark, out).agg(F.sum("point_count").alias("n"), steady(F.min("min_x")).alias("min_x"), steady(F.max("max_z")).alias("max_z"))


@query(f"""with {POINTS}, {GRID}, {LOW} select 1 as band, "row", col, arg_min(value, band) as value from low group by "row", col""")
def source_tiff(spark: SparkSession, folder: str) -> DataFrame:
    """The mosaic, written as GeoTIFF tiles and read again."""
    spec = fine(header(spark, folder))
    cells = low(spark, folder).groupBy("row", "col").agg(F.min_by("value", "band").alias("value")).select(F.lit(1).alias("band"), "row", "col", "value")
    out = _folder(spark, "tiff")
    written = rasters.write_tiff_tiles(cells, spec, out, 128)
    written.write.format("noop").mode("overwrite").save()
    back = rasters.read_tiff(spark, out)
    return back.select("band", spec.row(F.col("y")).alias("row"), spec.col(F.col("x")).alias("col"), "value")


@query(f"""with {POINTS}, {GRID}, {LOW} select band, "row", col, value from low""")
def source_raster_store(spark: SparkSession, folder: str) -> DataFrame:
    out = _folder(spark, "store")
    rasters.write_store(low(spark, folder), fine(header(spark, folder)), out)
    return rasters.read_store(spark, out)[1].select("band", "row", "col", "value")


@query("select time_s, latitude, longitude, altitude, roll, pitch, heading from (select distinct * exclude received_at from pc_trajectory)")
def source_sbet(spark: SparkSession, folder: str) -> DataFrame:
    """The trajectories, written as SBET records and read again; a null is NaN in a record."""
    out = _folder(spark, "sbet")
    held = table(spark, folder, "pc_trajectory").dropDuplicates(["rec_id"])
    records.write_sbet(held, "flight_id", out, spark.sparkContext.defaultParallelism).write.format("noop").mode("overwrite").save()
    return records.read_sbet(spark, out).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("time_s", "latitude", "longitude", "altitude", "roll", "pitch", "heading")])


@query("select probe_id, x, y, z from pc_probe")
def source_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The probes, written as CSV and read again with the types that their values show."""
    out = _folder(spark, "csv")
    table(spark, folder, "pc_probe").write.option("header", True).csv(out)
    return records.read_csv(spark, out).select(F.col("probe_id").cast("long"), "x", "y", "z")


_CORNER = r"(-?[0-9.]+)\s+(-?[0-9.]+)"


@query(f"""with c as (select zone_id, list_transform(regexp_extract_all(wkt, '{_CORNER}', 1), lambda v: cast(v as double)) as x, list_transform(regexp_extract_all(wkt, '{_CORNER}', 2), lambda v: cast(v as double)) as y from survey_zone where wkt is not null)
  select len(x) as corners, {", ".join(f"{steady_sql(f'list_{f}({v})')} as {f}_{v}" for v in "xy" for f in ("min", "max"))}, {steady_sql("list_sum(list_transform(x, lambda v: v - 400000)) / len(x)")} as mean_x, {steady_sql("list_sum(list_transform(y, lambda v: v - 6000000)) / len(y)")} as mean_y from c where len(x) > 0
  union all select 0, null, null, null, null, null, null from survey_zone where wkt is null or not regexp_matches(wkt, '{_CORNER}')""")
def source_shapefile(spark: SparkSession, folder: str) -> DataFrame:
    """The zones, written as shapefiles and read again: corners, box and mean corner of each; a zone without a shape is a null shape."""
    out = _folder(spark, "shp")
    vectors.write_shp(table(spark, folder, "survey_zone"), out).write.format("noop").mode("overwrite").save()
    at = lambda k: F.transform(F.regexp_extract_all("wkt", F.lit(_CORNER), F.lit(k)), lambda v: v.cast("double"))
    held = vectors.read_shp(spark, out).select(at(1).alias("x"), at(2).alias("y"))
    mean = lambda c, origin: F.aggregate(c, F.lit(0.0), lambda s, v: s + (v - origin)) / F.size(c)
    kept = held.select(F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("corners"), *[steady(f(v)).alias(f"{n}_{v}") for v in "xy" for n, f in (("min", F.array_min), ("max", F.array_max))], steady(mean("x", 400000.0)).alias("mean_x"), steady(mean("y", 6000000.0)).alias("mean_y"))
    return kept.withColumn("corners", F.when(F.col("corners") > 0, F.col("corners")).otherwise(0))


@query(f"""{WITH}, {_HEIGHTS}, t as (select "row", col, h, row_number() over (partition by "row", col order by h, point_id)::double as r, count(*) over (partition by "row", col)::double as n from h where h >= {THRESHOLD}),
  l as (select "row", col, max(n) as n, avg(h) as l1, sum((r - 1 - (n - r)) * h) / (max(n) * (max(n) - 1) / 2) / 2 as l2 from t group by 1, 2 having max(n) >= 2), g as (select "row", col, count(*) as n_all from h group by 1, 2)
  select l."row", l.col, {steady_sql("1 - n / n_all")} as gap, {steady_sql("l1")} as l1, {steady_sql("l2")} as l2, 21 as n_lhq, 1.0 as all_above from l join g on l."row" = g."row" and l.col = g.col""")
def grid_biometrics(spark: SparkSession, folder: str) -> DataFrame:
    """The 49 forest measures in one pass; the SQL has those that other queries don't have, and the sizes of the rest."""
    held = gridding.biometrics(_heights(spark, folder), ["row", "col"], "h", "point_id", THRESHOLD).where("l2 is not null")
    return held.select("row", "col", steady(F.col("gap")).alias("gap"), steady(F.col("l1")).alias("l1"), steady(F.col("l2")).alias("l2"), F.size("lhq").alias("n_lhq"), F.when((F.element_at("ccf", 21) == 0) & (F.size("ccf") == 21), 1.0).otherwise(0.0).alias("all_above"))


@query(f"""with {POINTS}, {GRID}, {LOW}, t as (select *, "row" // 16 as tr, col // 16 as tc from low) select band, cast(tr as integer) as tile_row, cast(tc as integer) as tile_col, count(*) as own, max(value) as top from t group by 1, 2, 3""")
def raster_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of 16 cells with a halo of 2; the own cells of each."""
    held = raster.tiles(low(spark, folder), 16, 2).where("own")
    return held.groupBy("band", "tile_row", "tile_col").agg(F.count(F.lit(1)).alias("own"), F.max("value").alias("top"))



@query(f"""with {POINTS}, {GRID}, {LOW}, t as (select band, "row", col, value, tr, tc from (select *, unnest(range(cast(floor(("row" - 2) / 16.0) as integer), cast(floor(("row" + 2) / 16.0) as integer) + 1)) as tr from low), unnest(range(cast(floor((col - 2) / 16.0) as integer), cast(floor((col + 2) / 16.0) as integer) + 1)) u(tc) where tr >= 0 and tc >= 0)
  select band, cast(tr as integer) as tile_row, cast(tc as integer) as tile_col, count(*) filter (where "row" // 16 <> tr or col // 16 <> tc) as halo, max(value) as top from t group by 1, 2, 3""")
def raster_halo(spark: SparkSession, folder: str) -> DataFrame:
    """Tiles of 16 cells with a halo of 2: the cells of each that are halo, and the greatest value of all."""
    return raster.tiles(low(spark, folder), 16, 2).groupBy("band", "tile_row", "tile_col").agg(F.count_if(~F.col("own")).alias("halo"), F.max("value").alias("top"))
