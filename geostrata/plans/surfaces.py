"""Queries over rasters, surfaces, neighbours, regions and trajectories."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import Box
from ..operators import focal, interp, joins, kdsplit, kmeans, pathfind, raster, regions, sorting, surface
from ..session import table
from ..sources import info
from ..streaming import finalise
from .registry import FINE, GRID, LOW, POINTS, fine, header, linked_sql, low, points, query, steady, steady_sql

WITH = f"with {POINTS}, {GRID}, {LOW}"


@query(f"""{WITH} select band, min(value) as "min", max(value) as "max", {steady_sql("avg(value)")} as mean, count(*) as "count", {steady_sql("var_pop(value)")} as variance, {steady_sql("stddev_pop(value)")} as stddev from low group by band""")
def raster_stats(spark: SparkSession, folder: str) -> DataFrame:
    return raster.stats(low(spark, folder)).select("band", "min", "max", steady(F.col("mean")).alias("mean"), "count", steady(F.col("variance")).alias("variance"), steady(F.col("stddev")).alias("stddev"))


@query(f"""{WITH} select l.band, "row", col, {steady_sql("(value - m) / s")} as value from low l join (select band, avg(value) as m, stddev_pop(value) as s from low group by band) t on l.band = t.band""")
def raster_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return raster.z_score(low(spark, folder)).withColumn("value", steady(F.col("value")))


@query(f"""{WITH} select l.band, "row", col, {steady_sql("ln(1 + (exp(1) - 1) * (value - a) / (b - a))")} as value from low l join (select band, min(value) as a, max(value) as b from low group by band) t on l.band = t.band""")
def raster_lognorm(spark: SparkSession, folder: str) -> DataFrame:
    return raster.log_normalise(low(spark, folder)).withColumn("value", steady(F.col("value")))


@query(f"""{WITH}, ground as (select file_id as band, cast(trunc((y - tly) / -{FINE}) as integer) as "row", cast(trunc((x - tlx) / {FINE}) as integer) as col, min(z) as g from pts, grid where cls = 2 group by 1, 2, 3)
  select coalesce(l.band, g.band) as band, coalesce(l."row", g."row") as "row", coalesce(l.col, g.col) as col, {steady_sql("coalesce(top + -1.0 * g, top, -1.0 * g)")} as value from low l full join ground g on l.band = g.band and l."row" = g."row" and l.col = g.col""")
def raster_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """The top of each cell less its ground."""
    return joins.overlay(low(spark, folder, top=True), _ground(spark, folder), -1.0).withColumn("value", steady(F.col("value")))


def _ground(spark: SparkSession, folder: str, by_file: bool = True) -> DataFrame:
    spec = fine(header(spark, folder))
    band = F.col("file_id") if by_file else F.lit(1)
    return points(spark, folder).where("cls = 2").groupBy(band.alias("band"), spec.row(F.col("y")).alias("row"), spec.col(F.col("x")).alias("col")).agg(F.min("z").alias("value"))


@query(f"""{WITH}, b as (select band, "row" - 60 + 20 as "row", col - 40 + 10 as col, value as v from low where "row" between 60 and 109 and col between 40 and 139), s as (select * from b where "row" >= 0 and col >= 0)
  select coalesce(l.band, s.band) as band, coalesce(l."row", s."row") as "row", coalesce(l.col, s.col) as col, coalesce(v, value) as value from low l full join s on l.band = s.band and l."row" = s."row" and l.col = s.col""")
def raster_shift_copy(spark: SparkSession, folder: str) -> DataFrame:
    """A block of each band written over the band itself, up and to the left."""
    held = low(spark, folder)
    return raster.copy_block(held, held, 40, 60, 100, 50, 10, 20, fine(header(spark, folder)))


@query(f"""{WITH}, w as (select band, cast(r as integer) as "row", cast(c as integer) as col from (select distinct band from low), unnest(range(60, 80)) a(r), unnest(range(-2, 60)) b(c))
  select w.band, w."row", w.col, case when w.col < 0 then -1.0 else value end as value from w left join low l on w.band = l.band and w."row" = l."row" and w.col = l.col""")
def raster_window(spark: SparkSession, folder: str) -> DataFrame:
    return raster.window(low(spark, folder), fine(header(spark, folder)), -2, 60, 62, 20, -1.0)


@query(f"""{WITH} select 1 as band, "row", col, arg_min(value, band) as value from low group by "row", col""")
def raster_mosaic(spark: SparkSession, folder: str) -> DataFrame:
    """Of each cell the value of the first file that has one; files in their order."""
    held = low(spark, folder)
    return held.groupBy("row", "col").agg(F.min_by("value", "band").alias("value")).select(F.lit(1).alias("band"), "row", "col", "value")


@query(f"""{WITH}, s as (select 1 as band, "row", col, min(value) as value from low group by 2, 3 union all select 2 as band, "row", col, max(top) as value from low group by 2, 3) select * from s""")
def band_stack(spark: SparkSession, folder: str) -> DataFrame:
    spec = fine(header(spark, folder))
    a = low(spark, folder).groupBy("row", "col").agg(F.min("value").alias("value"))
    b = low(spark, folder, top=True).groupBy("row", "col").agg(F.max("value").alias("value"))
    return raster.stack([(spec, a), (spec, b)])[1]


@query(f"""{WITH} select band, "row", col, case when value between 0 and 255.99999 then cast(trunc(value) as smallint) end as value from low""")
def raster_convert(spark: SparkSession, folder: str) -> DataFrame:
    return raster.convert(low(spark, folder).withColumn("value", F.when(F.col("value").between(0, 255.99999), F.col("value"))), "Byte")


@query(f"""{WITH}, t as (select "row", col, max(top) as value from low group by 1, 2), l as (select distinct cast(floor(10 + i * 0.5 + 0.5) as integer) as col, 60 + i as "row" from unnest(range(51)) a(i))
  select 1 as band, coalesce(t."row", l."row") as "row", coalesce(t.col, l.col) as col, case when l.col is null then value else greatest(coalesce(value, 300.0), 300.0) end as value from t full join l on t."row" = l."row" and t.col = l.col""")
def raster_line(spark: SparkSession, folder: str) -> DataFrame:
    held = low(spark, folder, top=True).groupBy("row", "col").agg(F.max("value").alias("value")).select(F.lit(1).alias("band"), "row", "col", "value")
    return raster.draw_line(held, fine(header(spark, folder)), 10, 60, 35, 110, 300.0)


@query(f"""{WITH}, ground as (select cast(trunc((y - tly) / -{FINE}) as integer) as "row", cast(trunc((x - tlx) / {FINE}) as integer) as col, min(z) as g from pts, grid where cls = 2 group by 1, 2)
  select point_id, {steady_sql("greatest(0.0, z - g)")} as height from pts, grid, ground where cast(trunc((y - tly) / -{FINE}) as integer) = "row" and cast(trunc((x - tlx) / {FINE}) as integer) = col""")
def point_height_normalize(spark: SparkSession, folder: str) -> DataFrame:
    held = surface.normalise_heights(points(spark, folder), _ground(spark, folder, by_file=False), fine(header(spark, folder)))
    return held.select("point_id", steady(F.col("z")).alias("height"))


@query(f"""{WITH}, g as (select "row", col, min(value) as v from low group by 1, 2), p as (select probe_id, x, y, (x - tlx) / {FINE} - 0.5 as u, (y - tly) / -{FINE} - 0.5 as w from pc_probe, grid where x is not null and y is not null),
  q as (select probe_id, cast(floor(u) as integer) + i as col, cast(floor(w) as integer) + j as "row", (case when i = 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case when j = 1 then w - floor(w) else 1 - (w - floor(w)) end) as k from p, unnest([0, 1]) a(i), unnest([0, 1]) b(j))
  select probe_id, {steady_sql("case when count(v) = 4 then sum(k * v) end")} as sampled from q left join g on q."row" = g."row" and q.col = g.col group by probe_id""")
def bilinear_sample(spark: SparkSession, folder: str) -> DataFrame:
    probes = table(spark, folder, "pc_probe").where("x is not null and y is not null")
    surface_ = low(spark, folder).groupBy("row", "col").agg(F.min("value").alias("value"))
    return joins.bilinear(probes, "probe_id", surface_, fine(header(spark, folder))).select("probe_id", steady(F.col("sampled")).alias("sampled"))


@query(f"""with {POINTS}, k as (select distinct cast(trunc(x * 100) as bigint) as a, cast(trunc(y * 100) as bigint) as b, cast(trunc(z * 100) as bigint) as c from pts where cls = 2)
  select point_id, case when k.a is not null then 2 else cls end as cls from pts left join k on cast(trunc(x * 100) as bigint) = k.a and cast(trunc(y * 100) as bigint) = k.b and cast(trunc(z * 100) as bigint) = k.c""")
def ground_assign(spark: SparkSession, folder: str) -> DataFrame:
    held = points(spark, folder)
    return surface.assign_ground(held, held.where("cls = 2")).select("point_id", "cls")


@query(f"""with {POINTS}, {GRID}, c as (select point_id, z, cast(trunc((x - tlx) / res_x) as integer) as col, cast(trunc((y - tly) / res_y) as integer) as "row" from pts, grid),
  r as (select *, row_number() over (partition by "row", col order by z desc, point_id) as k, count(*) over (partition by "row", col) as n from c) select point_id, "row", col from r where k <= 3 and n >= 3""")
def thin_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The three highest points of each cell that has three."""
    spec = header(spark, folder)
    held = points(spark, folder).select("point_id", "z", spec.col(F.col("x")).alias("col"), spec.row(F.col("y")).alias("row"))
    return surface.thin(held, ["row", "col"], 3, order=-F.col("z")).select("point_id", "row", "col")


@query(f"""with {POINTS}, {GRID}, s as (select z, c + i as col, r + j as "row", 1 - (power(x - (tlx + (c + i + 0.5) * res_x), 2) + power(y - (tly + (r + j + 0.5) * res_y), 2)) / (res_x * res_x) as w
  from (select x, y, z, cast(trunc((x - tlx) / res_x) as integer) as c, cast(trunc((y - tly) / res_y) as integer) as r from pts, grid), grid, unnest([-1, 0, 1]) a(i), unnest([-1, 0, 1]) b(j) where c + i >= 0 and r + j >= 0)
  select "row", col, {steady_sql("sum(w * z) / sum(w)")} as value from s where w > 1e-9 group by 1, 2 having sum(w) > 0.01""")
def weighted_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Mean heights with points spread over the cells around them; cells with next to no weight are left out."""
    found = surface.weighted_cell_mean(points(spark, folder), header(spark, folder)).where("weight > 0.01")
    return found.select("row", "col", steady(F.col("value")).alias("value"))


_KNN = "select p.probe_id, q.point_id, {d} as d2 from pc_probe p, pts q where p.x is not null and p.y is not null and p.z is not null"
_D3 = "power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2)"


@query(f"""with {POINTS}, d as ({_KNN.format(d=_D3)}), r as (select *, row_number() over (partition by probe_id order by d2, point_id) as k from d) select probe_id, point_id, cast(k as integer) as rank from r where k <= 5""")
def knn_points(spark: SparkSession, folder: str) -> DataFrame:
    found = joins.knn(table(spark, folder, "pc_probe"), "probe_id", points(spark, folder), "point_id", ["x", "y", "z"], 5)
    return found.select(F.col("query_id").alias("probe_id"), F.col("id").alias("point_id"), F.col("rank").cast("int").alias("rank"))


@query(f"""with {POINTS}, d as ({_KNN.format(d=_D3)} and {_D3} <= 36), r as (select *, row_number() over (partition by probe_id order by d2, point_id) as k from d) select probe_id, point_id, cast(k as integer) as rank from r where k <= 4""")
def fixed_radius_knn(spark: SparkSession, folder: str) -> DataFrame:
    found = joins.knn(table(spark, folder, "pc_probe"), "probe_id", points(spark, folder), "point_id", ["x", "y", "z"], 4, 6.0)
    return found.select(F.col("query_id").alias("probe_id"), F.col("id").alias("point_id"), F.col("rank").cast("int").alias("rank"))


@query(f"""with {POINTS} select probe_id, (select count(*) from pts q where power(p.x - q.x, 2) + power(p.y - q.y, 2) <= 100) as n from pc_probe p""")
def range_count(spark: SparkSession, folder: str) -> DataFrame:
    found = joins.range_count(table(spark, folder, "pc_probe"), "probe_id", points(spark, folder), "point_id", ["x", "y"], 10.0)
    return found.select(F.col("query_id").alias("probe_id"), "n")


@query("""with e as (select vec_id, embedding::double[] as v from embeddings), d as (select a.vec_id, b.vec_id as other, list_sum(list_transform(range(1, 65), lambda i: power(a.v[i] - b.v[i], 2))) as d2 from e a, e b where a.vec_id % 50 = 0),
  r as (select *, row_number() over (partition by vec_id order by d2, other) as k from d) select vec_id, other, cast(k as integer) as rank from r where k <= 5""")
def knn_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors of each vector whose id is divisible by 50, itself included."""
    held = table(spark, folder, "embeddings")
    found = joins.embedding_knn(held.where("vec_id % 50 = 0"), held, "vec_id", "embedding", 5, 64)
    return found.select(F.col("query_id").alias("vec_id"), F.col("id").alias("other"), F.col("rank").cast("int").alias("rank"))


@query(f"""with {POINTS}, c as (select zone_id, unnest(regexp_extract_all(wkt, '(-?[0-9.]+)\\s+(-?[0-9.]+)', 1))::double as x, unnest(regexp_extract_all(wkt, '(-?[0-9.]+)\\s+(-?[0-9.]+)', 2))::double as y from survey_zone where wkt is not null),
  b as (select zone_id as box_id, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from c group by 1)
  select box_id, count(*) as n, max(z) as top from b, pts where x >= minx and x < maxx and y >= miny and y < maxy group by box_id""")
def box_search(spark: SparkSession, folder: str) -> DataFrame:
    """The points in the box of each zone."""
    return joins.box_search(points(spark, folder), joins.boxes_of(table(spark, folder, "survey_zone"), "zone_id", "wkt"), 100.0).groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"))


@query(f"""with {POINTS} select point_id from pts where x > 400050.0005 and x <= 400200 and y > 5999400.0002 and x + y < 400250.0005 + 5999400.0002 and not (x > 400080.0005 and x < 400100.0005 and y > 5999420.0002 and y < 5999440.0002)""")
def polygon_search(spark: SparkSession, folder: str) -> DataFrame:
    """Points in a triangle with a square hole."""
    return joins.polygon_search(points(spark, folder), "point_id", "POLYGON ((400050.0005 5999400.0002, 400250.0005 5999400.0002, 400050.0005 5999600.0002, 400050.0005 5999400.0002), (400080.0005 5999420.0002, 400100.0005 5999420.0002, 400100.0005 5999440.0002, 400080.0005 5999440.0002, 400080.0005 5999420.0002))").join(points(spark, folder).where("x <= 400200").select("point_id"), "point_id")


@query("""with f as (select distinct file_id, min_x, min_y, max_x, max_y from pc_file where min_x is not null and min_y is not null and max_x is not null and max_y is not null and not isnan(min_x) and not isnan(min_y) and not isnan(max_x) and not isnan(max_y)),
  t as (select distinct c, r from (select *, unnest(range(cast(floor(min_x / 500) as bigint), cast(floor(max_x / 500) as bigint) + 1)) as c from f), unnest(range(cast(floor(min_y / 500) as bigint), cast(floor(max_y / 500) as bigint) + 1)) u(r))
  select distinct c + (r - 11998) * 4294967296 as tile_id, file_id from t, f where min_x < c * 500 + 520 and max_x > c * 500 - 20 and min_y < r * 500 + 520 and max_y > r * 500 - 20""")
def tile_files(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of all that the files cover, with the files that meet them."""
    files = table(spark, folder, "pc_file")
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / 500).cast("long"), F.floor(F.col(high) / 500).cast("long")))
    held = files.where(kdsplit.present(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]) & (F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))
    tiles = held.select(span("min_x", "max_x").alias("c"), "min_y", "max_y").select("c", span("min_y", "max_y").alias("r")).distinct()
    boxes = tiles.select((F.col("c") + (F.col("r") - 11998) * (1 << 32)).alias("tile_id"), (F.col("c") * 500.0).alias("minx"), (F.col("r") * 500.0).alias("miny"), ((F.col("c") + 1) * 500.0).alias("maxx"), ((F.col("r") + 1) * 500.0).alias("maxy"))
    return joins.tile_files(boxes, files, 20.0, 500.0)


_MEANS = [(400100.0, 5999500.0), (402000.0, 5999500.0), (404500.0, 5999450.0), (406500.0, 5999600.0)]
_MEAN_D = [f"((x - {a}) * (x - {a}) + (y - {b}) * (y - {b}))" for a, b in _MEANS]


@query(f"""with {POINTS}, d as (select x, y, [{", ".join(_MEAN_D)}] as d from pts), c as (select x, y, cast(list_position(d, list_min(d)) - 1 as integer) as cluster from d) select cluster, count(*) as n, {steady_sql("avg(x)")} as x, {steady_sql("avg(y)")} as y from c group by cluster""")
def kmeans_step(spark: SparkSession, folder: str) -> DataFrame:
    found = kmeans.lloyd_step(points(spark, folder), _MEANS, ["x", "y"])
    return found.select("cluster", "n", steady(F.col("x")).alias("x"), steady(F.col("y")).alias("y"))


@query()
def kmeans_points(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of eight clusters in plan."""
    return kmeans.kmeans(points(spark, folder), 8, ["x", "y"])[1].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_FLIGHT = f"""with {POINTS}, p as (select point_id, flight_id, gps_time as t from pts join pc_file on pts.file_id = pc_file.file_id where flight_id is not null),
  j as (select flight_id, time_s as t, max(rec_id) as rec_id from pc_trajectory where time_s is not null group by 1, 2)"""


def _flown(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, folder, "pc_file").where("flight_id is not null").select("file_id", "flight_id")
    left = points(spark, folder).join(files, "file_id").select("point_id", "flight_id", F.col("gps_time").alias("t"))
    return left, table(spark, folder, "pc_trajectory").select("flight_id", F.col("time_s").alias("t"), "rec_id")


@query(f"{_FLIGHT} select point_id, j.rec_id as rec_id_as_of from p asof left join j on p.flight_id = j.flight_id and p.t >= j.t")
def asof_backward(spark: SparkSession, folder: str) -> DataFrame:
    """The last trajectory record at or before each point."""
    left, right = _flown(spark, folder)
    return joins.as_of(left, right, ["flight_id"], "t", ["rec_id"], chunk=500.0).select("point_id", "rec_id_as_of")


@query(f"{_FLIGHT} select point_id, j.rec_id as rec_id_as_of from p asof left join j on p.flight_id = j.flight_id and p.t <= j.t")
def asof_forward(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _flown(spark, folder)
    return joins.as_of(left, right, ["flight_id"], "t", ["rec_id"], forward=True, chunk=500.0).select("point_id", "rec_id_as_of")


@query(f"with {POINTS} select point_id, y, x from pts order by y, x")
def sort_row_major(spark: SparkSession, folder: str) -> DataFrame:
    return sorting.by_row(points(spark, folder)).select("point_id", "y", "x")


@query(f"""with {POINTS}, u as (select point_id, cast(floor((x - 400000) / 1.0) as bigint) as u, cast(floor((y - 5000000) / 1.0) as bigint) as v from pts)
  select point_id, cast(list_sum(list_transform(range(31), lambda i: (((u >> i) & 1) << (2 * i)) + (((v >> i) & 1) << (2 * i + 1)))) as bigint) as morton from u""")
def sort_morton(spark: SparkSession, folder: str) -> DataFrame:
    return sorting.by_morton(points(spark, folder), 400000.0, 5000000.0, 1.0, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))).select("point_id", "morton")


_KERNEL = focal.gaussian_kernel(5, 0.8)
_WEIGHTS = ", ".join(f"({i - 2}, {j - 2}, {_KERNEL[i, j]!r})".replace("np.float64", "") for i in range(5) for j in range(5))


@query(f"""{WITH}, k(i, j, w) as (values {_WEIGHTS}) select band, "row" + i as "row", col + j as col, {steady_sql("sum(w * value) / sum(w)")} as value from low, k where "row" + i >= 0 and col + j >= 0 group by band, "row" + i, col + j""")
def focal_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    return focal.gaussian_smooth(low(spark, folder), 5, 0.8).withColumn("value", steady(F.col("value")))


_EXTENT = 'ext as (select band, min("row") as r0, max("row") as r1, min(col) as c0, max(col) as c1 from low group by band)'
_VOIDS = f"""{_EXTENT}, frame as (select band, r0, r1, c0, c1, cast(r as integer) as "row", cast(c as integer) as col from (select *, unnest(range(r0, r1 + 1)) as r from ext), unnest(range(c0, c1 + 1)) b(c)),
  n as materialized (select f.band, f."row", f.col, row_number() over (order by f.band, f."row", f.col) as id from frame f left join low l on f.band = l.band and f."row" = l."row" and f.col = l.col where l.value is null),
  e1 as (select p.id as a, q.id as b from n p join n q on q.band = p.band and q."row" = p."row" + 1 and q.col = p.col union all select p.id, q.id from n p join n q on q.band = p.band and q."row" = p."row" and q.col = p.col + 1),
  e as materialized (select a, b from e1 union all select b, a from e1), {linked_sql()}"""
_LABEL = 'label as (select n.band, n."row", n.col, o."row" * 2147483648 + o.col as region from linked l join n on n.id = l.id join n o on o.id = l.f)'


def _frames(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    held = low(spark, folder)
    return held, held.groupBy("band").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))


def _voids(spark: SparkSession, folder: str) -> DataFrame:
    held, frames = _frames(spark, folder)
    # rows are spread over the tasks before they become cells, for the mosaic's frame alone is most of them
    cells = frames.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).repartition("band", "row").withColumn("col", F.explode(F.sequence("min_col", "max_col"))).select("band", "row", "col")
    return cells.join(held.drop("value"), ["band", "row", "col"], "left_anti").withColumn("value", F.lit(1.0))


@query(f"""with {POINTS}, {GRID}, {LOW}, {_VOIDS}, {_LABEL} select band, "row", col, cast(region as bigint) as region from label""")
def region_components(spark: SparkSession, folder: str) -> DataFrame:
    """The regions of cells without data, inside each file's frame."""
    return regions.components(_voids(spark, folder)).select("band", "row", "col", "region")


@query(f"""with {POINTS}, {GRID}, {LOW}, {_VOIDS}, {_LABEL} select band, cast(region as bigint) as region, min("row") as min_row, max("row") as max_row, min(col) as min_col, max(col) as max_col, count(*) as area from label group by band, region""")
def region_bbox(spark: SparkSession, folder: str) -> DataFrame:
    return regions.boxes(regions.components(_voids(spark, folder))).drop("value")


@query(f"""with {POINTS}, {GRID}, {LOW}, {_VOIDS}, {_LABEL},
  box as (select l.band, region, min("row") as a, max("row") as b, min(col) as c, max(col) as d from label l group by 1, 2), hole as (select box.* from box join ext on box.band = ext.band where a > r0 and b < r1 and c > c0 and d < c1)
  select l.band, l."row", l.col, {steady_sql("sum(power(1.0 / (power(l.row - v.row, 2) + power(l.col - v.col, 2)), 2) * value) / sum(power(1.0 / (power(l.row - v.row, 2) + power(l.col - v.col, 2)), 2))")} as value
  from label l join hole h on l.band = h.band and l.region = h.region join low v on v.band = h.band and v."row" between a - 1 and b + 1 and v.col between c - 1 and d + 1 group by 1, 2, 3""")
def void_fill_idw(spark: SparkSession, folder: str) -> DataFrame:
    held, frames = _frames(spark, folder)
    return regions.void_fill(held, frames).withColumn("value", steady(F.col("value")))


_STEPS = 'steps as (select band, "row", col, cast(floor(value / 10) as integer) + 100 as v from low)'


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return low(spark, folder).withColumn("value", (F.floor(F.col("value") / 10).cast("int") + 100))


@query(f"""{WITH}, {_STEPS}, r as (select *, col - row_number() over (partition by band, "row", v order by col) as g from steps) select band, "row", min(col) as first, max(col) as last, v as value from r group by band, "row", v, g""")
def runs(spark: SparkSession, folder: str) -> DataFrame:
    return raster.runs(_steps(spark, folder))


_SESSIONS = """p as (select distinct band, v, "row" from steps), q as (select *, case when lag("row") over (partition by band, v order by "row") = "row" - 1 then 0 else 1 end as b from p),
  s as (select band, v, "row", cast(sum(b) over (partition by band, v order by "row") as integer) as session from q)"""


@query(f"""{WITH}, {_STEPS}, {_SESSIONS} select band, v as value, session, min("row") as first_row, max("row") as last_row from s group by 1, 2, 3""")
def polygon_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return regions.sessions(_steps(spark, folder)).groupBy("band", "value", "session").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))


@query(f"""{WITH}, {_STEPS}, {_SESSIONS} select steps.band, cast(steps.v as bigint) as id, session, {steady_sql(f"count(*) * {FINE * FINE}")} as area from steps join s on steps.band = s.band and steps.v = s.v and steps."row" = s."row" where steps.v > 0 group by 1, 2, 3""")
def polygon_area(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of the polygons of ten-metre height steps."""
    found = regions.polygonise(_steps(spark, folder), fine(header(spark, folder)))
    return found.select("band", "id", "session", steady(F.col("area")).alias("area"))


@query()
def polygon_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return regions.polygonise(_steps(spark, folder), fine(header(spark, folder)), remove_dangles=True, remove_holes=True)


@query()
def astar_cost(spark: SparkSession, folder: str) -> DataFrame:
    """The least-cost way between the first and the last cell of each file's lowest points."""
    held, _ = _frames(spark, folder)
    smooth = focal.gaussian_smooth(held, 5, 0.8)
    ends = held.groupBy("band").agg(F.min(F.struct("row", "col")).alias("a"), F.max(F.struct("row", "col")).alias("b"))
    asks = ends.select("band", F.col("a.row").alias("start_row"), F.col("a.col").alias("start_col"), F.col("b.row").alias("goal_row"), F.col("b.col").alias("goal_col"))
    return pathfind.least_cost_paths(smooth, asks, fine(header(spark, folder))).select("band", "cost", "steps")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Ground points with the number of their cell."""
    spec = header(spark, folder)
    held = points(spark, folder).where("cls = 2")
    return held.select((spec.row(F.col("y")).cast("long") * spec.cols + spec.col(F.col("x"))).alias("cell"), "x", "y", "z")


@query()
def spline_eval(spark: SparkSession, folder: str) -> DataFrame:
    return interp.group_models(_blocks(spark, folder), "cell", "spline")


@query()
def rbf_eval(spark: SparkSession, folder: str) -> DataFrame:
    return interp.group_models(_blocks(spark, folder), "cell", "rbf", span=20.0)


@query()
def rugosity(spark: SparkSession, folder: str) -> DataFrame:
    return interp.cell_rugosity(_blocks(spark, folder), "cell", header(spark, folder).half_diagonal)


@query()
def cloud_match(spark: SparkSession, folder: str) -> DataFrame:
    """The smoothed difference of the files of two flights."""
    held = points(spark, folder)
    return surface.match_clouds(held.where("file_id % 2 = 0"), held.where("file_id % 2 = 1"), header(spark, folder), 1.0)


@query(f"""{WITH}, m as (select "row", col, arg_min(value, band) as value from low group by "row", col), g as (select cast(trunc((y - tly) / res_y) as integer) as r, cast(trunc((x - tlx) / res_x) as integer) as c, min(z) as v from pts, grid group by 1, 2),
  p as (select m.*, ((col + 0.5) * {FINE}) / res_x - 0.5 as u, ((m."row" + 0.5) * -{FINE}) / res_y - 0.5 as w from m, grid),
  q as (select "row", col, value, cast(floor(u) as integer) + i as cc, cast(floor(w) as integer) + j as rr, (case when i = 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case when j = 1 then w - floor(w) else 1 - (w - floor(w)) end) as k from p, unnest([0, 1]) a(i), unnest([0, 1]) b(j))
  select 1 as band, "row", col, {steady_sql("case when count(v) = 4 then value - sum(k * v) end")} as value from q left join g on rr = g.r and cc = g.c group by "row", col, value""")
def datum_shift(spark: SparkSession, folder: str) -> DataFrame:
    """The mosaic less a coarse surface of lowest points."""
    spec, coarse = fine(header(spark, folder)), header(spark, folder)
    held = points(spark, folder)
    shift = held.groupBy(coarse.row(F.col("y")).alias("row"), coarse.col(F.col("x")).alias("col")).agg(F.min("z").alias("value"))
    return surface.shift_datum(raster_mosaic(spark, folder), spec, shift, coarse).withColumn("value", steady(F.col("value")))


@query(f"""with {POINTS} select point_id, cast(floor((x - 400000) / 250) as bigint) + i as tile_col, cast(floor((y - 5999000) / 250) as bigint) + j as tile_row, i = 0 and j = 0 as own from pts, unnest([-1, 0, 1]) a(i), unnest([-1, 0, 1]) b(j)
  where floor((x - 400000) / 250) + i between floor((x - 400000 - 10) / 250) and floor((x - 400000 + 10) / 250) and floor((y - 5999000) / 250) + j between floor((y - 5999000 - 10) / 250) and floor((y - 5999000 + 10) / 250)""")
def retile(spark: SparkSession, folder: str) -> DataFrame:
    return surface.retile(points(spark, folder), 250.0, 10.0, 400000.0, 5999000.0).select("point_id", "tile_col", "tile_row", "own")


@query(f"with {POINTS} select point_id, x + 5 as x, y - 2 as y, {steady_sql('z + 0.25')} as z from pts")
def perturb(spark: SparkSession, folder: str) -> DataFrame:
    held = surface.perturb(points(spark, folder), 5.0, -2.0, 0.25, 0.0, 1)
    return held.select("point_id", "x", "y", steady(F.col("z")).alias("z"))


@query("""with t as (select distinct rec_id, latitude, longitude from pc_trajectory) select rec_id, true as same from t""")
def utm_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether positions come back from their UTM zone to within a hundredth of a millimetre."""
    held = table(spark, folder, "pc_trajectory").select("rec_id", "latitude", "longitude").distinct()
    lat, lon = F.col("latitude"), F.col("longitude")
    zone = 28
    x, y = surface.to_utm(lat, lon, zone)
    back = held.withColumns({"x": x, "y": y}).withColumns(dict(zip(("a", "b"), surface.from_utm(F.col("x"), F.col("y"), zone), strict=True)))
    return back.select("rec_id", ((F.abs(F.col("a") - lat) < 1e-9) & (F.abs(F.col("b") - lon) < 1e-9)).alias("same"))


@query("""select file_id, regexp_replace(filename, '[^0-9A-Za-z]+', '_', 'g') as sane, regexp_replace(filename, '\\.[^.]*$', '') as base, split_part(filename, '.', -1) as ext, lower(sensor) as sensor, len(string_split(filename, '_')) as parts,
  regexp_full_match(filename, '\\s*[+-]?\\d+\\s*') as whole from pc_file""")
def str_helpers(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("filename")
    return table(spark, folder, "pc_file").select("file_id", scalar.sanitize(name).alias("sane"), scalar.basename(name).alias("base"), scalar.extension(name).alias("ext"), F.lower("sensor").alias("sensor"), F.size(scalar.split(name, "_")).cast("long").alias("parts"), scalar.is_int(name).alias("whole"))


@query("select doc_id, md5(text) as digest from documents")
def md5_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("""select file_id, min_x as minx, min_y as miny, max_x as maxx, max_y as maxy from pc_file where min_x is not null and not isnan(min_x)""")
def bounds_text(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds to text and back."""
    held = table(spark, folder, "pc_file").where("min_x is not null and not isnan(min_x)")
    text = scalar.bounds_text(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return held.select("file_id", scalar.parse_bounds(text).alias("b")).select("file_id", "b.minx", "b.miny", "b.maxx", "b.maxy")


@query("select event_id, " + "lpad(cast(cast(floor(value) as bigint) // 3600 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(value) as bigint) % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(value) as bigint) % 60 as varchar), 2, '0') as clock from events where value >= 0")
def clock_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("value >= 0").select("event_id", scalar.clock(F.col("value")).alias("clock"))


@query(f"""with {POINTS} select point_id, {steady_sql("sqrt(power(x - 400000, 2) + power(y - 5999400, 2))")} as far, {steady_sql("abs(3 * (x - 400000) - 4 * (y - 5999400)) / 5")} as off_line, {steady_sql("degrees(radians(scan_angle))")} as angle from pts""")
def scalar_distances(spark: SparkSession, folder: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    at = F.lit
    return points(spark, folder).select("point_id", steady(F.hypot(x - 400000.0, y - 5999400.0)).alias("far"), steady(scalar.point_line_distance(x - 400000.0, y - 5999400.0, at(0.0), at(0.0), at(4.0), at(3.0))).alias("off_line"), steady(F.degrees(F.radians("scan_angle"))).alias("angle"))


@query()
def dataset_info_json(spark: SparkSession, folder: str) -> DataFrame:
    held = info.point_cloud_info(points(spark, folder))
    return held.unionByName(info.raster_info(low(spark, folder), fine(header(spark, folder)))).unionByName(info.layer_info(table(spark, folder, "survey_zone")))


@query("""with w as (select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2) select window_start, event_type, n from w where window_start + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def stream_cell_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Final counts of hourly windows by event type, from a stream of the events."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = finalise.cell_counts(stream, "ts", "1 hour", "10 minutes", ["event_type"], "value")
    return finalise.run_to_table(spark, found).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def box_of(df: DataFrame) -> Box:
    """The box of a DataFrame's x and y, one row to the driver."""
    r = df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return Box(*map(float, r)) if r[0] is not None else Box(math.nan, math.nan, math.nan, math.nan)
