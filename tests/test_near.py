import numpy as np
import pytest

from geostrata.functions.wkt import parse_polygons, sweep_inside
from pyspark.sql import functions as F

from geostrata.operators import kdsplit
from geostrata.operators import near as near_module
from geostrata.operators.near import expand, near

NAN = float("nan")


def found(spark, rows, zones=None, **options):
    points = spark.createDataFrame(rows, "point_id long, x double, y double, id string, leaf int")
    shapes = None if zones is None else spark.createDataFrame(zones, "zone_id long, wkt string, x string")
    return sorted(map(tuple, expand(*near(points, "point_id", "x", "y", 0.12, shapes, **options)).collect()))


def brute(rows):
    held = {r[0]: (r[1], r[2]) for r in rows if None not in (r[0], r[1], r[2]) and r[1] == r[1] and r[2] == r[2]}
    ids = sorted(held)
    return sorted(("point", a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (held[a][0] - held[b][0]) ** 2 + (held[a][1] - held[b][1]) ** 2 <= 0.12)


def test_nulls_copies_and_deliveries(spark):
    rows = [(1, 400000.0, 6e6, "a", 1), (1, 400000.0, 6e6, "b", 2), (2, 400000.2, 6e6, None, None), (3, 400000.0, 6e6, "", 3), (4, None, 6e6, "", 3), (5, NAN, 1.0, "", 3), (None, 400000.0, 6e6, "", 3), (6, 400009.0, 6e6, "x" * 100_000, 1), (7, float("inf"), 6e6, "", 0)]
    assert found(spark, rows) == brute(rows[:-1]) == [("point", 1, 2), ("point", 1, 3), ("point", 2, 3)]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [], [(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))", "")]) == []


@pytest.mark.parametrize("leaf_rows", [50, 100_000])
def test_against_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(4)
    rows = [(int(i), float(x), float(y), "", 0) for i, (x, y) in enumerate(np.round(rng.random((600, 2)) * 8 + 400000, 2))]
    assert found(spark, rows, leaf_rows=leaf_rows) == brute(rows)


def test_hot_place(spark, monkeypatch):
    monkeypatch.setattr(kdsplit, "hot_positions", lambda sample, least=20: _hot(sample, least))
    rng = np.random.default_rng(4)
    rows = [(int(i), 400000.0, 6e6, "", 0) for i in range(30)] + [(int(i + 30), float(x), 6e6, "", 0) for i, x in enumerate(400000 + rng.random(40))]
    assert found(spark, rows) == brute(rows)


def _hot(sample, least):
    values, counts = np.unique(sample, axis=0, return_counts=True)
    return values[counts >= least]


def test_zones(spark):
    rows = [(10, 5.0, 5.0, "", 0), (11, 2.0, 2.0, "", 0), (12, 15.0, 5.0, "", 0), (13, 25.0, 5.0, "", 0)]
    zones = [
        (1, "POLYGON ((4 4, 6 4, 6 6, 4 6, 4 4))", ""), (1, " polygon((0 0 ,10 0,10 10,0 10,0 0) , (1 1,3 1,3 3,1 3,1 1))", ""), (2, "MULTIPOLYGON (((14 4, 16 4, 16 6, 14 6, 14 4)), ((24 4,24 6,26 6,26 4,24 4)))", ""),
        (3, None, ""), (4, "", ""), (5, "POLYGON EMPTY", ""), (6, "POINT (5 5)", ""), (7, "POLYGON ((0 0, 1 x))", ""), (None, "POLYGON ((0 0, 9 0, 9 9, 0 0))", ""),
    ]
    assert found(spark, rows, zones) == [("zone", 1, 10), ("zone", 2, 12), ("zone", 2, 13)]


def test_sweep_against_crossing_numbers():
    rng = np.random.default_rng(3)
    for _ in range(30):
        angle = np.sort(rng.random(rng.integers(3, 40))) * 2 * np.pi
        ring = np.column_stack([np.cos(angle), np.sin(angle)]) * (0.3 + rng.random((len(angle), 1)))
        wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"
        p = rng.random((300, 2)) * 2 - 1
        p = p[np.argsort(p[:, 0])]
        inside = np.zeros(len(p), bool)
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            inside ^= ((y1 > p[:, 1]) != (y2 > p[:, 1])) & (p[:, 0] < (x2 - x1) * (p[:, 1] - y1) / (y2 - y1) + x1)
        assert (sweep_inside(parse_polygons(wkt), p[:, 0], p[:, 1]) == inside).all()


def test_a_hot_place_is_expanded_by_blocks(spark):
    """4,000 points at one place, and one beside it: no row of what is spread stands for more pairs than two blocks have."""
    members = spark.range(1, 4_001).select("id").withColumn("_rep", F.lit(1).cast("long"))
    pairs = spark.createDataFrame([("point", 1, 50_000), ("zone", 3, 1), ("point", 60_000, 60_001)], "kind string, id_a long, id_b long")
    got = near_module.expand(pairs, members)
    counts = {r["kind"]: (r["n"], r["same"]) for r in got.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id_a") >= F.col("id_b")).alias("same")).collect()}
    assert counts["point"] == (4_000 * 3_999 // 2 + 4_000 + 1, 0)
    assert counts["zone"][0] == 4_000
    assert got.where("id_b = 50000").count() == 4_000 and got.where("id_a = 60000").count() == 1


def test_two_hot_places(spark, monkeypatch):
    monkeypatch.setattr(near_module, "HOT_BLOCK", 7)
    monkeypatch.setattr(kdsplit, "hot_positions", lambda sample, least=20: _hot(sample, 20))
    rows = [(i, 400000.0 + 0.25 * (i % 2), 6e6, "", 0) for i in range(80)] + [(90, 400000.1, 6e6, "", 0), (91, 500000.0, 6e6, "", 0)]
    assert found(spark, rows) == brute(rows)
