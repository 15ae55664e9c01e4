"""Queries of operators that the other queries don't reach: edits, boxes, projections, filters, searches, formats and streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import Box, GridSpec
from ..operators import filters, gridding, interp, joins, kdsplit, kmeans, raster, regions, surface
from ..session import table
from ..sources import records, vectors
from ..streaming import finalise
from .cells import _HEIGHTS, THRESHOLD, WITH, _heights
from .registry import FINE, GRID, LOW, POINTS, fine, header, linked_sql, low, points, query, steady, steady_sql
from .sources import _folder
from .surfaces import _STEPS, _steps, box_of

RASTERS = f"with {POINTS}, {GRID}, {LOW}"


@query(f"""{RASTERS}, a as (select "row", col, min(value) as v from low where band % 2 = 0 group by 1, 2), b as (select "row", col, min(value) as v from low where band % 2 = 1 group by 1, 2)
  select 1 as band, coalesce(a."row", b."row") as "row", coalesce(a.col, b.col) as col, coalesce(a.v, b.v) as value from a full join b on a."row" = b."row" and a.col = b.col""")
def mosaic_of_two(spark: SparkSession, folder: str) -> DataFrame:
    """The rasters of the files of even number laid over those of odd number."""
    part = lambda odd: low(spark, folder).where(F.col("band") % 2 == odd).groupBy("row", "col").agg(F.min("value").alias("value")).select(F.lit(1).alias("band"), "row", "col", "value")
    return raster.mosaic([part(0), part(1)])


@query(f"""{RASTERS} select band, "row", col, case when value > 100 then null else value end as value, 'cleaned' as kind from low
  union all select band, "row", col, value, 'row' from low where "row" = 70 union all select band, "row", col, value, 'col' from low where col = 40 union all select band, "row", col, 3.5, 'filled' from low""")
def raster_edit(spark: SparkSession, folder: str) -> DataFrame:
    """High cells set to the sentinel and cleaned, one row, one column, and a band filled."""
    held = low(spark, folder)
    cleaned = raster.clean(raster.set_where(held, F.col("value") > 100, -9999.0), -9999.0)
    kinds = [("cleaned", cleaned), ("row", raster.row_of(held, 70)), ("col", raster.col_of(held, 40)), ("filled", raster.fill(held, 3.5))]
    named = [df.select("band", "row", "col", "value", F.lit(kind).alias("kind")) for kind, df in kinds]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query(f"""with {POINTS}, b as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from pts), h as (select *, greatest(x1 - x0, y1 - y0) / 2 as r, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my from b),
  s as (select 'snap' as kind, floor(x0 / 20) * 20 as minx, floor(y0 / 20) * 20 as miny, ceil(x1 / 20) * 20 as maxx, ceil(y1 / 20) * 20 as maxy from b
  union all select 'align', 7 + floor((x0 - 7) / 30) * 30, 11 + floor((y0 - 11) / 50) * 50, 7 + ceil((x1 - 7) / 30) * 30, 11 + ceil((y1 - 11) / 50) * 50 from b
  union all select 'cube', mx - r, my - r, mx + r, my + r from h union all select 'pad', x0 - 5, y0 - 5, x1 + 5, y1 + 5 from b
  union all select 'union', least(x0, 0), least(y0, 0), greatest(x1, 1), greatest(y1, 1) from b union all select 'part', x0, y0, (x0 + x1) / 2, (y0 + y1) / 2 from b
  union all select 'grid', floor(x0 / 20) * 20 - 20, floor(y0 / 20) * 20 - 20, ceil(x1 / 20) * 20 + 20, ceil(y1 / 20) * 20 + 20 from b)
  select kind, {", ".join(f"{steady_sql(c)} as {c}" for c in ("minx", "miny", "maxx", "maxy"))} from s""")
def extent_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The extent of the points, snapped, aligned, squared up, grown, united and cut."""
    box = box_of(points(spark, folder))
    middle = Box(box.minx - 9, box.miny - 9, (box.minx + box.maxx) / 2, (box.miny + box.maxy) / 2)
    kinds = {"snap": box.snap(20), "align": box.align(7, 11, 30, 50), "cube": box.cube(), "pad": box.pad(5), "union": box.union(Box(0, 0, 1, 1)), "part": box.intersection(middle) or box, "grid": GridSpec.gridding(box, 20.0, -20.0).bounds}
    rows = spark.createDataFrame([(k, float(b.minx), float(b.miny), float(b.maxx), float(b.maxy)) for k, b in kinds.items()], "kind string, minx double, miny double, maxx double, maxy double")
    return rows.select("kind", *[steady(F.col(c)).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


_E2 = 0.00669437999014132


@query(f"""with t as (select distinct rec_id, flight_id, latitude as f, longitude as l from pc_trajectory where latitude is not null and longitude is not null),
  p as (select *, 6378137.0 / sqrt(1 - {_E2} * power(sin(f), 2)) as n, power(tan(f), 2) as t, {_E2} / (1 - {_E2}) * power(cos(f), 2) as c, (l - radians(-15)) * cos(f) as a, {_E2} / (1 - {_E2}) as e,
    6378137.0 * ((1 - {_E2} / 4 - 3 * power({_E2}, 2) / 64 - 5 * power({_E2}, 3) / 256) * f - (3 * {_E2} / 8 + 3 * power({_E2}, 2) / 32 + 45 * power({_E2}, 3) / 1024) * sin(2 * f) + (15 * power({_E2}, 2) / 256 + 45 * power({_E2}, 3) / 1024) * sin(4 * f) - 35 * power({_E2}, 3) / 3072 * sin(6 * f)) as m from t),
  u as (select flight_id, 500000 + 0.9996 * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * e) * power(a, 5) / 120) as x,
    0.9996 * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * e) * power(a, 6) / 720)) as y from p)
  select flight_id, floor(min(x)) as min_x, floor(min(y)) as min_y, floor(max(x)) as max_x, floor(max(y)) as max_y from u group by flight_id""")
def utm_flights(spark: SparkSession, folder: str) -> DataFrame:
    """The extent of each flight in whole metres of UTM zone 28. The SQL has another series for the projection."""
    x, y = surface.to_utm(F.col("latitude"), F.col("longitude"), 28)
    held = table(spark, folder, "pc_trajectory").where("latitude is not null and longitude is not null").select("flight_id", x.alias("x"), y.alias("y"))
    whole = lambda c: F.floor(c).cast("double")
    return held.groupBy("flight_id").agg(whole(F.min("x")).alias("min_x"), whole(F.min("y")).alias("min_y"), whole(F.max("x")).alias("max_x"), whole(F.max("y")).alias("max_y"))


@query(f"""with recursive {POINTS}, {GRID}, {LOW}, near as (select band, "row", col, value from low where value between 40 and 90), seed as (select "row", col from near order by band, "row", col limit 1),
  reach(band, "row", col) as (select n.band, n."row", n.col from near n, seed s where n."row" = s."row" and n.col = s.col union select n.band, n."row", n.col from reach r join near n on n.band = r.band and abs(n."row" - r."row") + abs(n.col - r.col) = 1)
  select l.band, l."row", l.col, case when r.band is not null then -1.0 else value end as value from low l left join reach r on l.band = r.band and l."row" = r."row" and l.col = r.col""")
def flood_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of middling height that are connected to the first of them, filled."""
    held = low(spark, folder)
    target = F.col("value").between(40, 90)
    seed = held.where(target).orderBy("band", "row", "col").select("row", "col").first()
    return held if seed is None else regions.flood_fill(held, seed["row"], seed["col"], target, -1.0)


@query(f"""{RASTERS}, {_STEPS}, n as materialized (select *, row_number() over (order by band, "row", col) as id from steps),
  e as materialized (select p.id as a, q.id as b from (select *, "row" + i as r, col + j as c from n, unnest([-1, 0, 1]) i(i), unnest([-1, 0, 1]) j(j)) p join n q on q.band = p.band and q."row" = p.r and q.col = p.c and q.v = p.v where p.id <> q.id), {linked_sql()}
  select n.band, cast(o."row" * 2147483648 + o.col as bigint) as region, count(*) as area from linked l join n on n.id = l.id join n o on o.id = l.f group by 1, 2""")
def region_diagonal(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of equal height steps that may meet at corners."""
    return regions.components(_steps(spark, folder), diagonal=True).groupBy("band", "region").agg(F.count(F.lit(1)).alias("area"))


@query(f"""{RASTERS}, {_STEPS} select cast(v as bigint) as id, {steady_sql(f"count(*) * {FINE * FINE}")} as area from steps where v in (103, 104, 105, 110) group by v""")
def polygon_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of the polygons of some height steps alone."""
    found = regions.polygonise(_steps(spark, folder), fine(header(spark, folder)), ids=[103, 104, 105, 110], split_sessions=False)
    return found.groupBy("id").agg(steady(F.sum("area")).alias("area"))


@query(f"""with {POINTS}, d as (select p.probe_id, q.point_id, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2)) as d3, power(p.x - q.x, 2) + power(p.y - q.y, 2) as d2 from pc_probe p, pts q where p.x is not null and p.y is not null and p.z is not null),
  k as (select *, row_number() over (partition by probe_id order by d3, point_id) as exact, row_number() over (partition by probe_id order by d2, point_id) as flat from d),
  f as (select probe_id, point_id, d3, row_number() over (partition by probe_id order by d3, point_id) as i from k where flat <= 4), t as (select probe_id, point_id, d3, exact as i from k where exact <= 4)
  select f.probe_id, {steady_sql("avg(case when t.d3 > 0 then f.d3 / t.d3 - 1 else 0 end)")} as error, {steady_sql("avg(case when f.point_id in (select point_id from t u where u.probe_id = f.probe_id) then 1.0 else 0.0 end)")} as recall from f join t on f.probe_id = t.probe_id and f.i = t.i group by f.probe_id""")
def search_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How good the four nearest points in plan are as the four nearest in space."""
    probes, cloud = table(spark, folder, "pc_probe").where("x is not null and y is not null and z is not null"), points(spark, folder)
    flat = joins.knn(probes, "probe_id", cloud, "point_id", ["x", "y"], 4).select("query_id", "id")
    at = flat.join(probes.select(F.col("probe_id").alias("query_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"]), "query_id").join(cloud.select(F.col("point_id").alias("id"), "x", "y", "z"), "id")
    found = at.select("query_id", "id", sum((F.pow(F.col(c) - F.col(f"p{c}"), 2) for c in "xyz"), F.lit(0.0)).alias("d2"))
    exact = joins.knn(probes, "probe_id", cloud, "point_id", ["x", "y", "z"], 4)
    return joins.search_quality(found, exact).select(F.col("query_id").alias("probe_id"), steady(F.col("error")).alias("error"), steady(F.col("recall")).alias("recall"))


@query("select true as converged, -0.5 as dx, 0.25 as dy, -0.125 as dz")
def register_motion(spark: SparkSession, folder: str) -> DataFrame:
    """The motion that takes the probes, moved by (0.5, -0.25, 0.125), back to where they were, at their middle."""
    probes = table(spark, folder, "pc_probe").where("x is not null and y is not null and z is not null").select("probe_id", "x", "y", "z")
    moved = surface.perturb(probes, 0.5, -0.25, 0.125, 0.0, 1)
    converged, _, motion = surface.register(moved, probes, "probe_id")
    middle = moved.agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
    if middle["x"] is None:
        return spark.createDataFrame([], "converged boolean, dx double, dy double, dz double")
    at = [middle[c] for c in "xyz"]
    step = [float(sum(motion[i, j] * at[j] for j in range(3)) + motion[i, 3] - at[i]) for i in range(3)]
    return spark.createDataFrame([(converged, *step)], "converged boolean, dx double, dy double, dz double").select("converged", *[steady(F.col(c)).alias(c) for c in ("dx", "dy", "dz")])


@query(f"""{WITH}, {_HEIGHTS}, t as (select "row", col, h, row_number() over (partition by "row", col order by h, point_id)::double as r, count(*) over (partition by "row", col)::double as n from h where h >= {THRESHOLD}),
  l as (select "row", col, sum((r - 1 - (n - r)) * h) / (max(n) * (max(n) - 1) / 2) / 2 as l2,
    sum(((r - 1) * (r - 2) / 2 - 2 * (r - 1) * (n - r) + (n - r) * (n - r - 1) / 2) * h) / (max(n) * (max(n) - 1) * (max(n) - 2) / 6) / 3 as l3,
    sum(((r - 1) * (r - 2) * (r - 3) / 6 - 3 * (r - 1) * (r - 2) / 2 * (n - r) + 3 * (r - 1) * (n - r) * (n - r - 1) / 2 - (n - r) * (n - r - 1) * (n - r - 2) / 6) * h) / (max(n) * (max(n) - 1) * (max(n) - 2) * (max(n) - 3) / 24) / 4 as l4,
    list_sort(list(h))[cast(trunc((count(*) - 1) * 0.85) as integer) + 1] as p85 from t group by 1, 2 having max(n) >= 4)
  select "row", col, {steady_sql("l3 / l2")} as t3, {steady_sql("l4 / l2")} as t4, {steady_sql("p85")} as p85 from l where l2 > 1e-6""")
def grid_l_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of the moments and the 85th percentile among the forest measures."""
    held = gridding.biometrics(_heights(spark, folder), ["row", "col"], "h", "point_id", THRESHOLD)
    return held.where("l4 is not null and l2 > 1e-6").select("row", "col", steady(F.col("t3")).alias("t3"), steady(F.col("t4")).alias("t4"), steady(F.col("p85")).alias("p85"))


@query(f"with {POINTS} select point_id, x, y from pts order by x, y, point_id limit 500")
def first_points(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 points in the order of points, from west to east."""
    return surface.first_n(points(spark, folder), 500, ["x", "y", "point_id"]).select("point_id", "x", "y")


@query("""with t as (select distinct cast(floor(min_x / 500) as bigint) as c, cast(floor(min_y / 500) as bigint) as r from pc_file where min_x is not null and not isnan(min_x) and min_y is not null and not isnan(min_y))
  select c, r, cast(row_number() over (order by r * 500.0, c * 500.0) as integer) as place from t""")
def tile_order(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of the files' corners, in the order of their bounds: by miny, then minx."""
    held = table(spark, folder, "pc_file").where("min_x is not null and not isnan(min_x) and min_y is not null and not isnan(min_y)")
    tiles = held.select(F.floor(F.col("min_x") / 500).cast("long").alias("c"), F.floor(F.col("min_y") / 500).cast("long").alias("r")).distinct()
    return surface.tile_places(tiles.withColumns({"minx": F.col("c") * 500.0, "miny": F.col("r") * 500.0})).select("c", "r", "place")


@query("select rec_id, time_s, altitude, roll from (select distinct * exclude received_at from pc_trajectory)")
def source_smrmsg(spark: SparkSession, folder: str) -> DataFrame:
    """Records of ten doubles, written and read again; record ids travel as one of the doubles."""
    out = _folder(spark, "smrmsg")
    held = table(spark, folder, "pc_trajectory").dropDuplicates(["rec_id"])
    took = {"north_rms": "rec_id", "east_rms": "altitude", "roll_rms": "roll"}
    rows = held.select("flight_id", "time_s", *[F.col(took[n]).cast("double").alias(n) if n in took else F.lit(0.0).alias(n) for n in records.SMRMSG[1:]])
    records.write_records(rows, "flight_id", out, spark.sparkContext.defaultParallelism, records.SMRMSG).write.format("noop").mode("overwrite").save()
    there = lambda c: F.when(~F.isnan(c), F.col(c))
    return records.read_smrmsg(spark, out).select(F.col("north_rms").cast("long").alias("rec_id"), there("time_s").alias("time_s"), there("east_rms").alias("altitude"), there("roll_rms").alias("roll"))


@query("select zone_id, label, wkt, 7 as survey, 'Int,String,String,Int' as kinds from survey_zone")
def source_layer(spark: SparkSession, folder: str) -> DataFrame:
    """The zones as a layer with a constant field, converted to JSON, and read again; kinds are the layer's fields."""
    out = _folder(spark, "layer")
    vectors.write_layer(vectors.with_constants(table(spark, folder, "survey_zone"), survey=7), out, "zones", order=["zone_id"])
    kinds = ",".join(vectors.layer_fields(vectors.read_layer(spark, out, "zones")).values())
    vectors.convert(spark, os.path.join(out, "zones"), os.path.join(out, "json"), "json")
    return spark.read.schema("zone_id long, label string, wkt string, survey int").json(os.path.join(out, "json")).withColumn("kinds", F.lit(kinds))


@query("select zone_id, label, wkt from survey_zone")
def source_sqlite(spark: SparkSession, folder: str) -> DataFrame:
    """The zones through a local SQLite file, which is a sink of one machine."""
    path = _folder(spark, "zones") + ".sqlite"
    vectors.write_sqlite(table(spark, folder, "survey_zone").select("zone_id", "label", "wkt"), path)
    return vectors.read_sqlite(spark, path, schema="zone_id long, label string, wkt string")


@query("select cast(probe_id as varchar) as probe_id, true as text from pc_probe")
def source_csv_text(spark: SparkSession, folder: str) -> DataFrame:
    """The probes through CSV, read without types."""
    out = _folder(spark, "csv")
    table(spark, folder, "pc_probe").write.option("header", True).csv(out)
    held = records.read_csv(spark, out, typed=False)
    return held.select("probe_id", F.lit(all(t == "string" for _, t in held.dtypes)).alias("text"))


@query(f"""select vec_id, {steady_sql("list_sum(embedding::double[])")} as total, {steady_sql("embedding[1]::double")} as first from embeddings""")
def source_point_text(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors as lines of text, read again; the id is the first number of a line."""
    out = _folder(spark, "text")
    held = table(spark, folder, "embeddings")
    records.dump_points(held.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")), out)
    back = records.read_point_text(spark, out, 65).select(F.col("features")[0].cast("long").alias("vec_id"), F.slice("features", 2, 64).alias("v"))
    return back.select("vec_id", steady(F.aggregate("v", F.lit(0.0), lambda a, b: a + b)).alias("total"), steady(F.col("v")[0]).alias("first"))


@query("""with u as (select user_id, count(*) as n, max(ts) as last from events group by 1) select cast(user_id as varchar) as cell, n from u where last + interval '1 hour' < (select max(ts) from events) - interval '10 minutes'""")
def stream_idle_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose last event lies so far back that nothing more can come, with their number of events, from a stream."""
    found = finalise.finalise_cells(_stream(spark, folder), "ts", "10 minutes", "user_id", "value", 3_600_000)
    return finalise.run_to_table(spark, found.select("cell", "n"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '2 hours' then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts) as k from g),
  w as (select user_id, min(ts) as session_start, max(ts) + interval '2 hours' as session_end, count(*) as n from s group by user_id, k) select user_id, session_start, n from w where session_end <= (select max(ts) from events) - interval '10 minutes'""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users that are over, from a stream."""
    found = finalise.run_to_table(spark, finalise.id_sessions(_stream(spark, folder), "ts", "2 hours", "10 minutes", ["user_id"]))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""with b as (select ts, event_type, to_timestamp((floor(epoch(ts) / 1800) - k) * 1800)::timestamp as window_start from events, unnest([0, 1]) u(k)), w as (select window_start, event_type, count(*) as n from b group by 1, 2)
  select window_start, event_type, n from w where window_start + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Final counts of windows of an hour, one each half hour, from a stream."""
    found = finalise.run_to_table(spark, finalise.sliding_counts(_stream(spark, folder), "ts", "1 hour", "30 minutes", "10 minutes", ["event_type"]))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"""with e as (select vec_id, embedding::double[] as v, list_reverse(embedding::double[]) as w from embeddings)
  select vec_id, {steady_sql("list_sum(list_transform(range(1, 65), lambda i: power(v[i] - w[i], 2)))")} as d2, {steady_sql("list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - w[i])))")} as d1, {steady_sql("list_max(list_transform(range(1, 65), lambda i: abs(v[i] - w[i])))")} as dmax, {steady_sql("power(list_sum(list_transform(range(1, 65), lambda i: power(abs(v[i] - w[i]), 3))), 1 / 3.0::double)")} as d3 from e""")
def vector_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of each vector from itself turned round, in four metrics."""
    held = table(spark, folder, "embeddings")
    a, b = F.col("embedding"), F.reverse("embedding")
    each = {"d2": scalar.distance2(a, b), "d1": scalar.minkowski(a, b, 1), "dmax": scalar.minkowski(a, b, float("inf")).cast("double"), "d3": scalar.minkowski(a, b, 3)}
    return held.select("vec_id", *[steady(c).alias(n) for n, c in each.items()])


@query("""select linenumber, n, cast(case when n < 3 then 0 else n * (n - 1) * (n - 2) / 6 end as double) as triples, n * n as squared from (select l_linenumber as linenumber, cast(count(*) as double) as n from lineitem group by 1)""")
def combinations(spark: SparkSession, folder: str) -> DataFrame:
    """How many triples the lines of each number make, and the square of their number."""
    held = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("linenumber")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return held.select("linenumber", "n", scalar.combinations(F.col("n"), 3).alias("triples"), scalar.sq(F.col("n")).alias("squared"))


@query(r"""select file_id, '/survey/raw/' || filename as path, '/survey/raw' as parent, '/out/' || filename as moved, regexp_matches(regexp_extract(filename, '([0-9.]+)', 1), '^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$') as number from pc_file where filename is not null""")
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Folders and paths of the files, and whether the digits in a name are a number."""
    name = F.col("filename")
    path = scalar.join_path(F.lit("/survey/raw/"), name)
    return table(spark, folder, "pc_file").where(name.isNotNull()).select("file_id", path.alias("path"), scalar.parent(path).alias("parent"), scalar.join_path(F.lit("/out"), F.concat(F.lit("/"), name)).alias("moved"), scalar.is_double(F.regexp_extract(name, "([0-9.]+)", 1)).alias("number"))


@query(f"""with q as (select x, y, sqrt(x * x + y * y) / 5.0 as r1, sqrt(power(x - 10, 2) + power(y - 10, 2)) / 5.0 as r2, 1.0 as c, sqrt(8 + 1.0) as p from (select a::double as x, b::double as y from unnest(range(10)) a(a), unnest(range(10)) b(b)))
  select x, y, {steady_sql("10.0 / (2 * (c - p)) * (sqrt(r1 * r1 + 1) - sqrt(r2 * r2 + 1)) + 5")} as value from q""")
def rbf_two_points(spark: SparkSession, folder: str) -> DataFrame:
    """The surface through the heights 10 at (0, 0) and 0 at (10, 10), on a lattice of 10 x 10; the SQL is its closed form."""
    f = interp.Rbf([0.0, 10.0], [0.0, 10.0], [10.0, 0.0], span=5.0)
    at = [(float(x), float(y)) for x in range(10) for y in range(10)]
    values = f([p[0] for p in at], [p[1] for p in at])
    return spark.createDataFrame([(x, y, float(v)) for (x, y), v in zip(at, values, strict=True)], "x double, y double, value double").select("x", "y", steady(F.col("value")).alias("value"))


_STARTS = [(400100.0, 5999500.0), (402000.0, 5999500.0), (404500.0, 5999450.0), (406500.0, 5999600.0)]


def _lloyd(n: int) -> str:
    """Rounds of Lloyd's steps in SQL."""
    parts = [f"m0 as (select * from (values {', '.join(f'({i}, {x!r}, {y!r})' for i, (x, y) in enumerate(_STARTS))}) v(k, x, y))"]
    for i in range(1, n + 1):
        parts.append(f"a{i} as (select p.x, p.y, arg_min(k, power(p.x - m.x, 2) + power(p.y - m.y, 2)) as k from (select point_id, x, y from pts) p, m{i - 1} m group by p.point_id, p.x, p.y)")
        parts.append(f"m{i} as (select m.k, coalesce(avg(a.x), any_value(m.x)) as x, coalesce(avg(a.y), any_value(m.y)) as y, count(a.x) as n from m{i - 1} m left join a{i} a on a.k = m.k group by m.k)")
    return f"with {POINTS}, " + ", ".join(parts)


@query(f"{_lloyd(3)} select k as cluster, {steady_sql('x')} as x, {steady_sql('y')} as y from m3")
def kmeans_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Means after three rounds from given starts."""
    means, _ = kmeans.kmeans(points(spark, folder), 4, ["x", "y"], rounds=3, starts=_STARTS)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(means)], "cluster int, x double, y double").select("cluster", steady(F.col("x")).alias("x"), steady(F.col("y")).alias("y"))


@query("select * from (values ('c=2,6;minz=0;maxz=120.5', 0.0, 120.5), ('minz=-3', -3.0, null), ('c=2', null, null)) v(spec, low, high)")
def filter_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The heights that filters let through, as far as they bound them."""
    rows = []
    for text in ("c=2,6;minz=0;maxz=120.5", "minz=-3", "c=2"):
        low_, high = filters.parse(text).z_bounds()
        rows.append((text, None if low_ == float("-inf") else float(low_), None if high == float("inf") else float(high)))
    return spark.createDataFrame(rows, "spec string, low double, high double")


@query(f"""with {POINTS}, b as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from pts) select point_id, x >= (x0 + x1) / 2 - 10 and x <= x1 + 10 and y >= y0 - 10 and y <= (y0 + y1) / 2 + 10 as near from pts, b""")
def box_near(spark: SparkSession, folder: str) -> DataFrame:
    """Whether points are in the south-eastern quarter of the extent or within ten metres of its box."""
    held = points(spark, folder)
    box = box_of(held)
    quarter = Box((box.minx + box.maxx) / 2, box.miny, box.maxx, (box.miny + box.maxy) / 2)
    return held.select("point_id", quarter.near(F.col("x"), F.col("y"), 10.0).alias("near"))


@query(f"""with {POINTS}, n as (select count(*) as n from pts) select cast(greatest(0, ceil(log2(n / 50000.0))) as integer) as depth, cast(power(2, greatest(0, ceil(log2(n / 50000.0)))) as bigint) as leaves, n as "rows" from n""")
def tree_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Depth, leaves and rows of the splits of the points."""
    found = kdsplit.leaf_stats(points(spark, folder), "point_id", ["x", "y", "z"])
    return found.agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("leaves"), F.sum("rows").alias("rows"))
