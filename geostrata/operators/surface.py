"""Work on point clouds against surfaces: heights, perturbation, thinning, matching, retiling, datum shift."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import GridSpec
from . import joins


def once(points: DataFrame, key: str = "point_id") -> DataFrame:
    """Each key once, however often it was delivered."""
    return points.dropDuplicates([key])


def normalise_heights(points: DataFrame, terrain: DataFrame, spec: GridSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """Points with z as the height above the terrain cell, at least 0; those outside it or on nodata are dropped."""
    return joins.lookup(points, terrain, spec, by=by).withColumn("z", F.greatest(F.lit(0.0), F.col("z") - F.col("cell_value"))).drop("cell_value")


def perturb(points: DataFrame, dx: float, dy: float, dz: float, sigma: float, seed: int) -> DataFrame:
    """Points shifted, with normal noise on each axis."""
    noise = lambda k: F.randn(seed + k) * sigma if sigma else F.lit(0.0)
    return points.withColumns({"x": F.col("x") + dx + noise(0), "y": F.col("y") + dy + noise(1), "z": F.col("z") + dz + noise(2)})


def thin(points: DataFrame, cell: list[str], n: int, order: Column | None = None, seed: int = 0, key: str = "point_id") -> DataFrame:
    """n points of each cell, by order or else at random by a hash of the key; a cell with fewer than n is emptied."""
    by = F.xxhash64(F.lit(seed), key) if order is None else order
    # the rank is limited where the points lie, so a cell with many points sends n of them from each task
    first = points.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy(by, key))).where(F.col("_rank") <= n)
    return first.withColumn("_full", F.count(F.lit(1)).over(Window.partitionBy(*cell))).where(F.col("_full") == n).drop("_rank", "_full")


def shuffled(points: DataFrame, seed: int, key: str = "point_id") -> DataFrame:
    return points.orderBy(F.xxhash64(F.lit(seed), key), key)


def first_n(points: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n points in an order; each task sends n of them at most."""
    return points.orderBy(*order).limit(n)


def tile_places(tiles: DataFrame) -> DataFrame:
    """Tiles (minx, miny) with their place in the order of their bounds, by miny and then minx, from 1. Tiles are few beside points: they are numbered in one task."""
    return tiles.withColumn("place", F.row_number().over(Window.orderBy("miny", "minx")))


def assign_ground(points: DataFrame, ground: DataFrame, cls: int = 2) -> DataFrame:
    """All points; those that agree with a ground point in trunc(100 x), trunc(100 y) and trunc(100 z) have the class."""
    code = lambda c: (F.col(c) * 100).cast("long")
    keys = ground.select(*[code(c).alias(f"_{c}") for c in "xyz"]).distinct().withColumn("_ground", F.lit(True))
    keyed = points.withColumns({f"_{c}": code(c) for c in "xyz"})
    return keyed.join(keys, ["_x", "_y", "_z"], "left").withColumn("cls", F.when(F.col("_ground"), F.lit(cls)).otherwise(F.col("cls"))).drop("_x", "_y", "_z", "_ground")


def weighted_cell_mean(points: DataFrame, spec: GridSpec) -> DataFrame:
    """(row, col, value, weight): each point spread to the 3 x 3 cells around it, weighted by 1 - d / res^2 with d the squared distance of the cell's middle; d beyond res^2 counts nothing."""
    col, row = spec.col(F.col("x")), spec.row(F.col("y"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = points.withColumn("_o", F.explode(offsets)).select("x", "y", "z", (col + F.col("_o.i")).alias("col"), (row + F.col("_o.j")).alias("row"))
    d = F.pow(F.col("x") - spec.x(F.col("col")), 2) + F.pow(F.col("y") - spec.y(F.col("row")), 2)
    res2 = spec.res_x * spec.res_x
    weighted = spread.where(spec.has(F.col("col"), F.col("row"))).withColumn("_w", F.lit(1.0) - d / res2).where(F.col("_w") > 1e-9)
    return weighted.groupBy("row", "col").agg((F.sum(F.col("_w") * F.col("z")) / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"))


def match_clouds(a: DataFrame, b: DataFrame, spec: GridSpec, smoothing: float, tile: int = 64, halo: int = 8) -> DataFrame:
    """(row, col, value): the smoothed difference b - a of the two clouds' grids, where both have data.

    Each tile of cells, with a halo, is smoothed by a spline of its own.
    """
    from .interp import smooth_tiles

    left, right = weighted_cell_mean(a, spec).select("row", "col", F.col("value").alias("_a")), weighted_cell_mean(b, spec).select("row", "col", F.col("value").alias("_b"))
    difference = left.join(right, ["row", "col"]).select(F.lit(1).alias("band"), "row", "col", (F.col("_b") - F.col("_a")).alias("value"))
    return smooth_tiles(difference, smoothing, tile, halo).select("row", "col", "value")


def retile(points: DataFrame, size: float, buffer: float, easting: float = 0.0, northing: float = 0.0) -> DataFrame:
    """Points with the tile that holds them, and copies (own false) in each tile whose buffer they are in."""
    at = lambda c, origin, grow: F.floor((F.col(c) - origin + grow) / size).cast("long")
    span = lambda c, origin: F.explode(F.sequence(at(c, origin, -buffer), at(c, origin, buffer)))
    spread = points.withColumn("tile_col", span("x", easting)).withColumn("tile_row", span("y", northing))
    return spread.withColumn("own", (F.col("tile_col") == at("x", easting, 0.0)) & (F.col("tile_row") == at("y", northing, 0.0)))


def tile_bounds(tile_col: Column, tile_row: Column, size: float, easting: float = 0.0, northing: float = 0.0) -> list[Column]:
    return [(tile_col * size + easting).alias("minx"), (tile_row * size + northing).alias("miny"), ((tile_col + 1) * size + easting).alias("maxx"), ((tile_row + 1) * size + northing).alias("maxy")]


#: WGS 84
_A, _INVERSE_F = 6378137.0, 298.257223563


def to_utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing of latitude and longitude (radians) in a northern UTM zone, by Krueger's series to the third flattening's third power."""
    n = (1 / _INVERSE_F) / (2 - 1 / _INVERSE_F)
    big_a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    lon0 = math.radians(zone * 6 - 183)
    sin = F.sin(lat)
    t = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi = F.atan2(t, F.cos(lon - lon0))
    eta = F.atanh(F.sin(lon - lon0) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * big_a * x, 0.9996 * big_a * y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude (radians) of a northern UTM zone's easting and northing."""
    n = (1 / _INVERSE_F) / (2 - 1 / _INVERSE_F)
    big_a = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (0.9996 * big_a), (x - 500000.0) / (0.9996 * big_a)
    xi_, eta_ = xi, eta
    for j, b in enumerate(beta, 1):
        xi_ = xi_ - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_ = eta_ - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return lat, math.radians(zone * 6 - 183) + F.atan2(F.sinh(eta_), F.cos(xi_))


def shift_datum(raster: DataFrame, spec: GridSpec, shift: DataFrame, shift_spec: GridSpec) -> DataFrame:
    """raster less the shift grid, sampled bilinearly at each cell's middle; null where a sample lacks a neighbour."""
    middles = raster.select("band", "row", "col", "value", spec.x(F.col("col")).alias("x"), spec.y(F.col("row")).alias("y")).withColumn("cell", F.struct("band", "row", "col"))
    sampled = joins.bilinear(middles, "cell", shift, shift_spec).select("cell", "sampled")
    return middles.join(sampled, "cell").select("band", "row", "col", (F.col("value") - F.col("sampled")).alias("value"))


def register(source: DataFrame, target: DataFrame, key: str, rounds: int = 30, tolerance: float = 1e-6, reach: float | None = None) -> tuple[bool, float, np.ndarray]:
    """Iterative closest point: (converged, fitness, 4 x 4 transform) that moves source onto target.

    Each round pairs every source point with its nearest target point (knn) and fits the rigid motion to the sums of the
    pairs, 16 numbers, which are all that reaches the driver. fitness is the mean squared distance of the last pairs.
    """
    total = np.eye(4)
    fitness = math.inf
    for _ in range(rounds):
        m = total
        moved = source.select(F.col(key).alias("_id"), *[(float(m[i, 0]) * F.col("x") + float(m[i, 1]) * F.col("y") + float(m[i, 2]) * F.col("z") + float(m[i, 3])).alias(c) for i, c in enumerate("xyz")])
        near = joins.knn(moved, "_id", target, key, ["x", "y", "z"], 1, reach).where("rank = 1")
        pairs = near.join(moved, near["query_id"] == moved["_id"]).select("x", "y", "z", "d2", "id").join(target.select(F.col(key).alias("id"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w")), "id")
        names = ["x", "y", "z", "u", "v", "w"]
        sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("d2").alias("fit"), *[F.avg(c).alias(c) for c in names], *[F.covar_pop(a, b).alias(f"{a}{b}") for a in "xyz" for b in "uvw"]).first()
        if not sums["n"]:
            return False, math.inf, total
        cov = np.array([[sums[f"{a}{b}"] for b in "uvw"] for a in "xyz"])
        left, _, right = np.linalg.svd(cov)
        turn = right.T @ np.diag([1, 1, np.sign(np.linalg.det(right.T @ left.T))]) @ left.T
        step = np.eye(4)
        step[:3, :3] = turn
        step[:3, 3] = np.array([sums[c] for c in "uvw"]) - turn @ np.array([sums[c] for c in "xyz"])
        total = step @ total
        if abs(fitness - sums["fit"]) < tolerance:
            return True, float(sums["fit"]), total
        fitness = float(sums["fit"])
    return False, fitness, total
