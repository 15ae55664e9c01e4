import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.functions.wkt import parse_polygons
from geostrata.model import GridSpec
from geostrata.operators import pathfind, regions
from geostrata.operators.interp import polygon_area

SCHEMA = "band int, row int, col int, value double"


def frame(spark, grid):
    return spark.createDataFrame([(1, r, c, float(v)) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None], SCHEMA)


def brute(grid, diagonal):
    label, steps = {}, [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for r in range(len(grid)):
        for c in range(len(grid[0])):
            if (r, c) in label:
                continue
            stack = [(r, c)]
            label[(r, c)] = r << 31 | c
            while stack:
                a, b = stack.pop()
                for i, j in steps:
                    n = (a + i, b + j)
                    if 0 <= n[0] < len(grid) and 0 <= n[1] < len(grid[0]) and n not in label and grid[n[0]][n[1]] == grid[a][b]:
                        label[n] = r << 31 | c
                        stack.append(n)
    return label


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [5, 512])
def test_components(spark, diagonal, tile):
    grid = np.random.default_rng(3).integers(0, 2, (17, 23)).tolist()
    got = {(r["row"], r["col"]): r["region"] for r in regions.components(frame(spark, grid), diagonal, tile).collect()}
    assert got == brute(grid, diagonal)


def test_a_long_region_over_many_tiles(spark):
    n = 40
    grid = [[1 if r % 2 == 0 or c == (0 if r % 4 == 3 else n - 1) else None for c in range(n)] for r in range(n)]
    got = regions.components(frame(spark, grid), tile=6)
    assert got.select("region").distinct().count() == 1


def test_components_of_nothing(spark):
    assert regions.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_polygons_with_holes_and_sessions(spark):
    grid = [[3, 3, 3, None], [3, None, 3, None], [3, 3, 3, 5], [None, None, None, None], [3, 3, None, None]]
    spec = GridSpec(100.0, 50.0, 2.0, -2.0, 4, 5)
    got = {(r["id"], r["session"]): r for r in regions.polygonise(frame(spark, grid), spec).collect()}
    assert set(got) == {(3, 1), (3, 2), (5, 1)}
    assert got[(3, 1)]["area"] == 32.0 and got[(3, 2)]["area"] == 8.0
    rings = parse_polygons(got[(3, 1)]["wkt"])[0]
    assert sorted(polygon_area(r[:-1]) for r in rings) == [4.0, 36.0]
    one = {r["id"]: r for r in regions.polygonise(frame(spark, grid), spec, split_sessions=False, remove_dangles=True, remove_holes=True).collect()}
    assert one[3]["n_parts"] == 1 and one[3]["area"] == 36.0
    assert {r["id"] for r in regions.polygonise(frame(spark, grid), spec, ids=[5]).collect()} == {5}


def test_diagonal_corners_stay_apart(spark):
    got = regions.polygonise(frame(spark, [[1, None], [None, 1]]), GridSpec(0, 2, 1, -1, 2, 2)).first()
    assert got["n_parts"] == 2 and got["area"] == 2.0


def test_flood_fill(spark):
    grid = [[1, 1, 0], [0, 1, 0], [0, 0, 1]]
    got = {(r["row"], r["col"]): r["value"] for r in regions.flood_fill(frame(spark, grid), 0, 0, F.col("value") == 1, 9.0).collect()}
    assert [k for k, v in sorted(got.items()) if v == 9.0] == [(0, 0), (0, 1), (1, 1)]


def test_void_fill(spark):
    grid = [[1, 2, 3, None], [4, None, 6, 7], [8, 9, 10, 11]]
    extents = spark.createDataFrame([(1, 0, 2, 0, 3)], "band int, min_row int, max_row int, min_col int, max_col int")
    got = regions.void_fill(frame(spark, grid), extents).collect()
    w = np.array([0.25, 1, 0.25, 1, 1, 0.25, 1, 0.25])
    assert [(r["row"], r["col"]) for r in got] == [(1, 1)] and np.isclose(got[0]["value"], (w * [1, 2, 3, 4, 6, 8, 9, 10]).sum() / w.sum())


def test_least_cost_path():
    cost = {(r, c): 0.0 for r in range(5) for c in range(5) if not (c == 2 and r < 4)}
    length, path = pathfind.astar(cost, (0, 0), (0, 4))
    assert path[0] == (0, 4) and path[-1] == (0, 0) and (4, 2) in path and np.isclose(length, 4 * 2**0.5 + 4)
    assert pathfind.astar(cost, (0, 0), (0, 2))[1] == [] and pathfind.astar(cost, (0, 0), (0, 4), most=3.0)[1] == []


@pytest.mark.parametrize("tile", [16, 512])
def test_large_holes_against_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    grid = np.where(rng.random((90, 100)) < 0.4, rng.random((90, 100)) * 9, np.nan)
    grid[20:70, 15:85] = np.nan
    grid[19:71, [14, 85]] = 1.0
    grid[[19, 70], 14:86] = 2.0
    cells = [(1, int(r), int(c), float(grid[r, c])) for r, c in zip(*np.nonzero(~np.isnan(grid)), strict=True)]
    held = spark.createDataFrame(cells, SCHEMA)
    frame_ = held.groupBy("band").agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    assert tuple(frame_.first()) == (1, 0, 89, 0, 99)
    got = {(r["row"], r["col"]): r["value"] for r in regions.void_fill(held, frame_, 2.0, tile).collect()}
    label = brute(np.isnan(grid).tolist(), False)
    holes = {}
    for (r, c), region in label.items():
        if np.isnan(grid[r, c]):
            holes.setdefault(region, []).append((r, c))
    want = {}
    for held in holes.values():
        r, c = np.array(held).T
        if r.min() == 0 or c.min() == 0 or r.max() == 89 or c.max() == 99:
            continue
        u, v = np.nonzero(~np.isnan(grid[r.min() - 1 : r.max() + 2, c.min() - 1 : c.max() + 2]))
        u, v = u + r.min() - 1, v + c.min() - 1
        for a, b in held:
            w = 1.0 / ((u - a) ** 2 + (v - b) ** 2) ** 2
            want[a, b] = (w * grid[u, v]).sum() / w.sum()
    assert got.keys() == want.keys() and len(want) > 3500
    assert max(abs(got[k] - x) for k, x in want.items()) < 1e-9


def test_squares_are_weighed_alike_cell_by_cell_and_as_a_convolution(monkeypatch):
    rng = np.random.default_rng(6)
    cells = np.argwhere(rng.random((64, 64)) < 0.5)
    other = np.argwhere(rng.random((64, 64)) < 0.6) + [64, 0]
    value = rng.random(len(other)) * 500
    fast = regions._weigh(*cells.T, *other.T, value, 2.0)
    parts = [regions._weigh(*p.T, *other.T, value, 2.0) for p in np.array_split(cells, 8)]
    slow = [np.concatenate([p[k] for p in parts]) for k in (0, 1)]
    assert np.abs(fast[1] / fast[0] - slow[1] / slow[0]).max() < 1e-5
