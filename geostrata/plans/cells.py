"""Queries that filter points, form cells and aggregate them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import GridSpec, pack_cell
from ..operators import aggregates as A
from ..operators import filters, gridding
from ..session import table
from .registry import CELLS, GRID, POINTS, header, points, query, steady, steady_sql

WITH = f"with {POINTS}, {CELLS}"


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.to_cells(points(spark, folder), header(spark, folder))


@query(f"""{WITH} select "row", col, count(*) as n, min(z) as min_z, max(z) as max_z, {steady_sql("avg(z)")} as mean_z, {steady_sql("var_samp(z)")} as var_z, {steady_sql("stddev_samp(z)")} as std_z,
  list_sort(list(z))[cast(trunc((count(*) - 1) * 0.5) as integer) + 1] as median_z from cells where cls in (1, 2, 6, 14) group by "row", col""")
def grid_basic_stats(spark: SparkSession, folder: str) -> DataFrame:
    z = F.col("z")
    kept = _cells(spark, folder).where(filters.in_class([1, 2, 6, 14]))
    return kept.groupBy("row", "col").agg(A.count(z).alias("n"), F.min(z).alias("min_z"), F.max(z).alias("max_z"), steady(F.avg(z)).alias("mean_z"), steady(A.variance(z)).alias("var_z"), steady(A.stddev(z)).alias("std_z"), A.median(z).alias("median_z"))


def _filter_query(name: str, spec: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return points(spark, folder).where(filters.parse(spec).column()).select("point_id")

    run.__name__, run.__doc__ = name, f"Points that pass {spec!r}."
    query(f"with {POINTS} select point_id from pts where {sql}")(run)


_filter_query("filter_class", "c=2,6", "cls in (2, 6)")
_filter_query("filter_z", "minz=20;maxz=300.5", "z between 20 and 300.5")
_filter_query("filter_intensity", "i=50,120", "intensity between 50 and 120")
_filter_query("filter_angle", "mina=-10;maxa=10", "scan_angle between -10 and 10")
_filter_query("filter_first", "f", "return_num = 1")
_filter_query("filter_last", "l", "return_num = num_returns")
_filter_query("filter_edge", "e", "not is_edge")
_filter_query("filter_combo", "-p:c=1,2;f;e;mini=40;maxa=15", "cls in (1, 2) and return_num = 1 and not is_edge and intensity >= 40 and scan_angle <= 15")


@query(f"""{WITH} select "row", col, count(*) as n, count(*) filter (where cls = 2) as n_ground, min(z) filter (where cls = 2) as ground, max(z) filter (where return_num = 1) as first_top,
  {steady_sql("avg(intensity) filter (where return_num = num_returns)")} as last_intensity from cells group by "row", col""")
def agg_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates with filters of their own, in one pass."""
    z, ground = F.col("z"), filters.parse("-f:min:c=2").column()
    return _cells(spark, folder).groupBy("row", "col").agg(F.count(z).alias("n"), F.count(F.when(ground, z)).alias("n_ground"), F.min(F.when(ground, z)).alias("ground"), F.max(F.when(filters.first_returns(), z)).alias("first_top"), steady(F.avg(F.when(filters.last_returns(), F.col("intensity")))).alias("last_intensity"))


_MOMENTS = """m as (select "row", col, count(*) as n, avg(z) as mu, stddev_samp(z) as s from cells group by 1, 2),
c as (select m."row", m.col, m.n, m.mu, m.s, avg(power(z - mu, 3)) as m3, avg(power(z - mu, 4)) as m4 from cells join m on cells."row" = m."row" and cells.col = m.col group by 1, 2, 3, 4, 5)"""


@query(f"""{WITH}, {_MOMENTS} select "row", col, n, {steady_sql("case when s > 0.001 then m3 / (s * s * s) end")} as skewness, {steady_sql("case when s > 0.001 then m4 / (s * s * s * s) - 3 end")} as kurtosis, {steady_sql("case when mu <> 0 then s / mu end")} as variation from c where n >= 5""")
def grid_skew_kurt_cov(spark: SparkSession, folder: str) -> DataFrame:
    z = F.col("z")
    spread = F.stddev_samp(z) > 0.001
    held = _cells(spark, folder).groupBy("row", "col").agg(F.count(z).alias("n"), steady(F.when(spread, A.skewness(z))).alias("skewness"), steady(F.when(spread, A.kurtosis(z))).alias("kurtosis"), steady(A.variation(z)).alias("variation"))
    return held.where("n >= 5")


def _place(p: float) -> str:
    return f"v[cast(trunc((len(v) - 1) * {p}) as integer) + 1]"


@query(f"""{WITH}, g as (select "row", col, list_sort(list(z)) as v from cells group by 1, 2) select "row", col, {_place(0)} as p0, {_place(0.25)} as q1, {_place(0.9)} as d9, {_place(0.85)} as p85, {_place(1)} as p100 from g""")
def grid_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """By ranks of a sort, so a cell may hold any number of points."""
    return gridding.ranked_percentiles(_cells(spark, folder), ["row", "col"], "z", {"p0": 0.0, "q1": 0.25, "d9": 0.9, "p85": 0.85, "p100": 1.0})


#: Cell middles that can be within a radius below the resolution, from the middles around each point's cell.
_AROUND = f"""{GRID}, near as (select p.*, c + i as col, r + j as "row", power(x - (tlx + (c + i + 0.5) * res_x), 2) + power(y - (tly + (r + j + 0.5) * res_y), 2) as d2
  from (select pts.*, cast(trunc((x - tlx) / res_x) as integer) as c, cast(trunc((y - tly) / res_y) as integer) as r from pts, grid) p, grid, unnest([-1, 0, 1]) a(i), unnest([-1, 0, 1]) b(j)
  where c + i between 0 and n_cols - 1 and r + j between 0 and n_rows - 1)"""


@query(f"""with {POINTS}, {_AROUND} select "row", col, count(*) as n, {steady_sql("avg(z)")} as mean_z, max(z) as max_z from near where d2 <= 300 group by 1, 2""")
def radius_join(spark: SparkSession, folder: str) -> DataFrame:
    """Points within a radius of each cell's middle."""
    z = F.col("z")
    return gridding.rasterize(points(spark, folder), header(spark, folder), {"mean_z": steady(F.avg(z)), "max_z": F.max(z)}, math.sqrt(300)).select("row", "col", F.col("count").alias("n"), "mean_z", "max_z")


@query(f"""with {POINTS}, {_AROUND} select "row", col, count(*) as n, max(z) as max_z from near where d2 > 25 and d2 <= 196 group by 1, 2""")
def annulus_search(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.annulus(points(spark, folder), header(spark, folder), 5.0, 14.0).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("max_z"))


@query(f"""with {POINTS}, {GRID} select "row", col, count(*) as n, min(z) as min_z from (select z, c + i as col, r + j as "row", abs(x - (tlx + (c + i + 0.5) * res_x)) as dx, abs(y - (tly + (r + j + 0.5) * res_y)) as dy
  from (select x, y, z, cast(trunc((x - tlx) / res_x) as integer) as c, cast(trunc((y - tly) / res_y) as integer) as r from pts, grid), grid, unnest([-1, 0, 1]) a(i), unnest([-1, 0, 1]) b(j)
  where c + i between 0 and n_cols - 1 and r + j between 0 and n_rows - 1) where dx <= 10 and dy <= 10 group by 1, 2""")
def cell_join(spark: SparkSession, folder: str) -> DataFrame:
    """Points in each closed cell; those on an edge count in all cells that share it."""
    return gridding.rasterize(points(spark, folder), header(spark, folder), {"min_z": F.min("z")}, 0).select("row", "col", F.col("count").alias("n"), "min_z")


@query(f"""with {POINTS}, {_AROUND}, w as (select "row", col, z, d2, power(1 / d2, 2) as w from near where d2 <= 200.00000000000003)
  select "row", col, {steady_sql("coalesce(max(z) filter (where d2 = 0), sum(w * z) / sum(w))")} as idw from w group by 1, 2""")
def grid_idw(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.rasterize(points(spark, folder), header(spark, folder), {"idw": steady(A.idw(F.col("z"), F.col("d2")))}, math.sqrt(200.00000000000003)).select("row", "col", "idw")


@query(f"""with {POINTS}, {_AROUND} select "row", col, {steady_sql(f"case when count(*) filter (where cls = 2) > 0 then count(*) / (pi() * 196) end")} as density, {steady_sql("1 - count(*) filter (where cls = 2) / count(*)::double")} as gap from near where d2 <= 196 group by 1, 2""")
def grid_density(spark: SparkSession, folder: str) -> DataFrame:
    ground = F.when(filters.in_class([2]), F.col("z"))
    return gridding.rasterize(points(spark, folder), header(spark, folder), {"density": steady(A.density(F.col("x"), ground, 14.0)), "gap": steady(A.gap_fraction(F.col("x"), ground))}, 14.0).select("row", "col", "density", "gap")


#: Heights above the cell's lowest point.
_HEIGHTS = 'h as (select "row", col, point_id, z - min(z) over (partition by "row", col) as h from cells)'
THRESHOLD = 0.5


def _heights(spark: SparkSession, folder: str) -> DataFrame:
    lowest = F.min("z").over(Window.partitionBy("row", "col"))
    return _cells(spark, folder).select("row", "col", "point_id", (F.col("z") - lowest).alias("h"))


@query(f"""{WITH}, {_HEIGHTS}, t as (select "row", col, h, row_number() over (partition by "row", col order by h, point_id)::double as r, count(*) over (partition by "row", col)::double as n from h where h >= {THRESHOLD}),
  l as (select "row", col, max(n) as n, avg(h) as l1,
    sum((r - 1 - (n - r)) * h) / (max(n) * (max(n) - 1) / 2) / 2 as l2,
    sum(((r - 1) * (r - 2) / 2 - 2 * (r - 1) * (n - r) + (n - r) * (n - r - 1) / 2) * h) / (max(n) * (max(n) - 1) * (max(n) - 2) / 6) / 3 as l3,
    sum(((r - 1) * (r - 2) * (r - 3) / 6 - 3 * (r - 1) * (r - 2) / 2 * (n - r) + 3 * (r - 1) * (n - r) * (n - r - 1) / 2 - (n - r) * (n - r - 1) * (n - r - 2) / 6) * h) / (max(n) * (max(n) - 1) * (max(n) - 2) * (max(n) - 3) / 24) / 4 as l4
    from t group by 1, 2 having max(n) >= 4)
  select "row", col, cast(n as bigint) as n, {steady_sql("l1")} as l1, {steady_sql("l2")} as l2, {steady_sql("l3")} as l3, {steady_sql("l4")} as l4 from l""")
def grid_lmoments(spark: SparkSession, folder: str) -> DataFrame:
    cell = Window.partitionBy("row", "col")
    held = _heights(spark, folder).where(F.col("h") >= THRESHOLD)
    ranked = held.select("row", "col", "h", F.row_number().over(cell.orderBy("h", "point_id")).alias("r"), F.count(F.lit(1)).over(cell).alias("n"))
    moments = A.l_moments(F.col("r"), F.col("n"), F.col("h"))
    return ranked.groupBy("row", "col").agg(F.max("n").alias("n"), *[steady(moments[k]).alias(k) for k in ("l1", "l2", "l3", "l4")]).where("n >= 4")


def _quantile(b: int, bands: int) -> str:
    if b in (0, bands):
        return "v[1]" if b == 0 else "v[len(v)]"
    rank = f"({b / bands} * (len(v) + 1))"
    low = f"greatest(1, least(len(v), cast(floor({rank}) as integer)))"
    return f"v[{low}] + greatest(0.0, least(1.0, {rank} - {low})) * (v[least(len(v), {low} + 1)] - v[{low}])"


@query(f"""{WITH}, {_HEIGHTS}, g as (select "row", col, list_sort(list(h)) as v from h where h >= {THRESHOLD} group by 1, 2), q as (select "row", col, unnest([{", ".join(_quantile(b, 20) for b in range(21))}]) as q, unnest(range(21)) as b from g)
  select "row", col, cast(b * 5 as integer) as pct, {steady_sql("q")} as height from q""")
def grid_lhq(spark: SparkSession, folder: str) -> DataFrame:
    """Heights at 0 to 100 % of each cell's ordered heights."""
    held = _heights(spark, folder).where(F.col("h") >= THRESHOLD).groupBy("row", "col").agg(A.height_quantiles(F.col("h")).alias("q"))
    return held.select("row", "col", F.posexplode("q").alias("b", "height")).select("row", "col", (F.col("b") * 5).cast("int").alias("pct"), steady(F.col("height")).alias("height"))


@query(f"""{WITH}, {_HEIGHTS}, m as (select "row", col, max(h) as top, count(*) as n from h group by 1, 2), s as (select m.*, b from m, unnest(range(21)) u(b) where top >= {THRESHOLD})
  select s."row", s.col, cast(b * 5 as integer) as pct, {steady_sql(f"count(*) filter (where h > {THRESHOLD} + (top - {THRESHOLD}) * (b / 20.0)) / n::double")} as share from s join h on s."row" = h."row" and s.col = h.col group by s."row", s.col, b, n""")
def grid_ccf(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a cell's points above each of 21 heights from the threshold to its top."""
    cell = Window.partitionBy("row", "col")
    held = _heights(spark, folder).withColumn("top", F.max("h").over(cell)).where(F.col("top") >= THRESHOLD)
    above = [F.count(F.when(F.col("h") > F.lit(THRESHOLD) + (F.col("top") - THRESHOLD) * F.lit(b / 20.0), 1)) for b in range(21)]
    shares = held.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.array(*above).alias("above"))
    return shares.select("row", "col", "n", F.posexplode("above").alias("b", "k")).select("row", "col", (F.col("b") * 5).cast("int").alias("pct"), steady(F.col("k") / F.col("n")).alias("share"))


@query(f"""{WITH}, {_HEIGHTS} select "row", col, {steady_sql(f"1 - count(*) filter (where h >= {THRESHOLD}) / count(*)::double")} as gap, {steady_sql(f"stddev_samp(h) filter (where h >= {THRESHOLD})")} as rugosity,
  list_sort(list(h) filter (where h >= {THRESHOLD}))[cast(trunc((count(*) filter (where h >= {THRESHOLD}) - 1) * 0.85) as integer) + 1] as p85 from h group by 1, 2""")
def grid_gap(spark: SparkSession, folder: str) -> DataFrame:
    tall = F.when(F.col("h") >= THRESHOLD, F.col("h"))
    return _heights(spark, folder).groupBy("row", "col").agg(steady(A.gap_fraction(F.col("h"), tall)).alias("gap"), steady(F.stddev_samp(tall)).alias("rugosity"), A.percentile(tall, 0.85).alias("p85"))


@query(f"""with s as (select file_id, min_x, min_y, max_x, max_y, point_count, (max_x - min_x) * (max_y - min_y) as area from pc_file where min_x is not null and not isnan(min_x))
  select {steady_sql("avg(point_count / (area / 400)) * (1.5 * pi() * 196 / 400)")} as density from s where area > 0""")
def density_estimate(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "pc_file").where("min_x is not null and not isnan(min_x)")
    return gridding.point_density(files, 20.0, 14.0).select(steady(F.col("density")).alias("density"))


@query(f"""with {POINTS} select file_id, count(*) as n, min(x) as min_x, min(y) as min_y, min(z) as min_z, max(x) as max_x, max(y) as max_y, max(z) as max_z from pts group by file_id""")
def file_extents(spark: SparkSession, folder: str) -> DataFrame:
    return points(spark, folder).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"])


@query(f"""with {POINTS} select min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy, floor(min(x) / 20) * 20 as snap_minx, ceil(max(y) / 20) * 20 as snap_maxy, cast(ceil((max(x) - min(x)) / 20) as integer) as cols from pts""")
def extent(spark: SparkSession, folder: str) -> DataFrame:
    held = points(spark, folder).agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    return held.withColumns({"snap_minx": F.floor(F.col("minx") / 20) * 20.0, "snap_maxy": F.ceil(F.col("maxy") / 20) * 20.0, "cols": F.ceil((F.col("maxx") - F.col("minx")) / 20).cast("int")})


@query(f"""{WITH} select distinct "row", col, cast(col as bigint) * 4294967296 + "row" as packed, cast("row" as bigint) * n_cols * 2 + n_cols + col as bil, n_cols * n_rows + cast("row" as bigint) * n_cols + col as bsq, cast("row" as bigint) * n_cols * 2 + col * 2 + 1 as bip,
  tlx + col * res_x + 0.5 * res_x as cx, tly + "row" * res_y + 0.5 * res_y as cy from cells, grid""")
def cell_index(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of the second of two bands' cells under each interleave, and the cells' middles."""
    one = header(spark, folder)
    spec = GridSpec(one.tlx, one.tly, one.res_x, one.res_y, one.cols, one.rows, 2)
    col, row = F.col("col"), F.col("row")
    return _cells(spark, folder).select("row", "col").distinct().select("row", "col", pack_cell(col, row).alias("packed"), *[spec.index(col, row, 1, i).alias(i.lower()) for i in ("BIL", "BSQ", "BIP")], spec.x(col).alias("cx"), spec.y(row).alias("cy"))


def computers() -> dict[str, Column]:
    """The aggregates that a caller of rasterize can name."""
    z = F.col("z")
    return {"min": F.min(z), "max": F.max(z), "mean": F.avg(z), "variance": A.variance(z), "std-dev": A.stddev(z), "median": A.median(z), "skewness": A.skewness(z), "kurtosis": A.kurtosis(z), "idw-2": A.idw(z, F.col("d2"))}


def computer(name: str) -> Column:
    """An aggregate by its name: one of computers(), or percentile-p, decile-n or quartile-n."""
    kind, _, n = name.partition("-")
    if kind in ("percentile", "decile", "quartile") and n:
        return A.percentile(F.col("z"), float(n) / {"percentile": 100, "decile": 10, "quartile": 4}[kind])
    known = computers()
    if name not in known:
        raise ValueError(f"no computer {name!r}")
    return known[name]
