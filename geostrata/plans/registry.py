"""Queries by name, with their SQL, and the views that several of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GridSpec
from ..operators import kdsplit
from ..operators.surface import once
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Side of the finer cells, in metres.
FINE = 5.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if SQL can state it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def steady(c: Column) -> Column:
    """Four decimals. The odd offset keeps fractions that sums of whole numbers often make away from the step."""
    return F.floor(c * 10000 + 0.3717) / 10000.0


def steady_sql(c: str) -> str:
    return f"floor(({c}) * 10000 + 0.3717) / 10000.0"


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Each point once, with a place and a possible height."""
    held = table(spark, folder, "pc_memgrid").drop("ingest_ts", "idx")
    kept = held.where(kdsplit.present(F.col("x"), F.col("y"), F.col("z")) & F.col("z").between(-500.0, 9000.0))
    return once(kept)


POINTS = """pts as (select distinct point_id, file_id, x, y, z, intensity, scan_angle, cls, return_num, num_returns, is_edge, gps_time
  from pc_memgrid where x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z) and z between -500 and 9000)"""


def header(spark: SparkSession, folder: str) -> GridSpec:
    """The survey's grid; its table is one row."""
    h = table(spark, folder, "grid_header").orderBy("grid_id").first()
    return GridSpec(h["tlx"], h["tly"], h["res_x"], h["res_y"], int(h["n_cols"]), int(h["n_rows"]))


def fine(spec: GridSpec) -> GridSpec:
    return spec.with_res(abs(spec.res_x) / FINE)


CELLS = """grid as (select tlx, tly, res_x, res_y, n_cols, n_rows from grid_header),
cells as (select p.*, cast(trunc((x - tlx) / res_x) as integer) as col, cast(trunc((y - tly) / res_y) as integer) as "row" from pts p, grid
  where (x - tlx) / res_x >= 0 and (x - tlx) / res_x < n_cols and (y - tly) / res_y >= 0 and (y - tly) / res_y < n_rows)"""

#: Lowest point of each fine cell of each file: band is the file.
LOW = f"""low as (select file_id as band, cast(trunc((y - tly) / -{FINE}) as integer) as "row", cast(trunc((x - tlx) / {FINE}) as integer) as col, min(z) as value, max(z) as top
  from pts, grid where x >= tlx and y <= tly group by 1, 2, 3)"""
GRID = "grid as (select tlx, tly, res_x, res_y, n_cols, n_rows from grid_header)"


def low(spark: SparkSession, folder: str, top: bool = False) -> DataFrame:
    spec = fine(header(spark, folder))
    held = points(spark, folder).select(F.col("file_id").alias("band"), spec.row(F.col("y")).alias("row"), spec.col(F.col("x")).alias("col"), "x", "y", "z").where((F.col("x") >= spec.tlx) & (F.col("y") <= spec.tly))
    return held.groupBy("band", "row", "col").agg((F.max("z") if top else F.min("z")).alias("value"))


def linked_sql(rounds: int = 16) -> str:
    """CTEs that end in linked(id, f): the smallest id that each node of n(id) is linked to by edges e(a, b), both ways. Each round hooks roots to smaller ones and halves the ways to them."""
    parts = ["f0 as materialized (select id, id as f from n)"]
    for i in range(rounds):
        parts.append(f"g{i} as materialized (select a.id, a.f, b.f as ff from f{i} a join f{i} b on b.id = a.f)")
        parts.append(f"m{i} as materialized (select e.a as id, min(g.ff) as least from e join g{i} g on g.id = e.b group by e.a)")
        parts.append(f"f{i + 1} as materialized (select id, min(f) as f from (select g.f as id, m.least as f from m{i} m join g{i} g on g.id = m.id union all select id, least from m{i} union all select id, ff from g{i}) group by id)")
    return ", ".join([*parts, f"linked as (select id, f from f{rounds})"])
