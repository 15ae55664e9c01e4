"""Least-cost paths over rasters."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GridSpec


def astar(cost: dict[tuple[int, int], float], start: tuple[int, int], goal: tuple[int, int], step: Callable[[float, float, float], float] | None = None, most: float = math.inf) -> tuple[float, list[tuple[int, int]]]:
    """Cost and cells, goal first, of the least-cost path over cells with data, 8-connected; an infinite cost without one.

    step(value here, value there, distance) is a step's cost, at least the distance; without it the distance of the two
    cells with their values as heights.
    """
    step = step or (lambda a, b, d: math.sqrt(d * d + (a - b) ** 2))
    if start not in cost or goal not in cost:
        return math.inf, []
    ahead = lambda c: math.hypot(c[0] - goal[0], c[1] - goal[1])
    best, came = {start: 0.0}, {}
    queue, done = [(ahead(start), start)], set()
    while queue:
        _, at = heapq.heappop(queue)
        if at == goal:
            path = [at]
            while at in came:
                at = came[at]
                path.append(at)
            return best[goal], path
        if at in done:
            continue
        done.add(at)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                to = (at[0] + dr, at[1] + dc)
                if to == at or to not in cost or to in done:
                    continue
                new = best[at] + step(cost[at], cost[to], math.hypot(dr, dc))
                if new < best.get(to, math.inf) and new <= most:
                    best[to], came[to] = new, at
                    heapq.heappush(queue, (new + ahead(to), to))
    return math.inf, []


def least_cost_paths(raster: DataFrame, requests: DataFrame, spec: GridSpec, most: float = math.inf) -> DataFrame:
    """(band, cost, steps, path) of each request (band, start_row, start_col, goal_row, goal_col) over its band.

    path lists x and y of the cells' middles, goal first. A band is searched in one task: a path may lead anywhere in it.
    """

    def search(cells: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(asks):
            held = {(r, c): v for r, c, v in zip(*(cells.column(n).to_pylist() for n in ("row", "col", "value")), strict=True)}
            for band, r0, c0, r1, c1 in zip(*(asks.column(n).to_pylist() for n in ("band", "start_row", "start_col", "goal_row", "goal_col")), strict=True):
                cost, path = astar(held, (r0, c0), (r1, c1), most=most)
                xy = [[spec.tlx + (c + 0.5) * spec.res_x, spec.tly + (r + 0.5) * spec.res_y] for r, c in path]
                out.append((band, None if math.isinf(cost) else cost, len(path), xy))
        return pa.table({"band": pa.array([o[0] for o in out], pa.int32()), "cost": pa.array([o[1] for o in out], pa.float64()), "steps": pa.array([o[2] for o in out], pa.int32()), "path": pa.array([o[3] for o in out], pa.list_(pa.list_(pa.float64())))})

    cells = raster.where(F.col("value").isNotNull()).select("band", "row", "col", F.col("value").cast("double").alias("value"))
    return cells.groupBy("band").cogroup(requests.groupBy("band")).applyInArrow(search, "band int, cost double, steps int, path array<array<double>>")

