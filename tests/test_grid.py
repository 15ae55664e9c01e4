import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.model import Box, GridSpec, pack_cell, unpack_cell
from geostrata.operators import aggregates as A
from geostrata.operators import filters, gridding, joins, kdsplit, raster, sorting, surface


@pytest.fixture(scope="module")
def lattice(spark):
    """100 x 100 points with whole coordinates from 100."""
    return spark.range(10_000).select(F.col("id").alias("point_id"), (100 + F.col("id") % 100).cast("double").alias("x"), (100 + F.floor(F.col("id") / 100)).cast("double").alias("y")).withColumn("z", F.col("x") * 2)


def test_spec():
    box = Box(1.5, 2.5, 9.2, 7.1)
    assert GridSpec.from_bounds(box, 2, -2).cols == 4 and GridSpec.from_bounds(box, 2, -2).tly == 7.1
    assert box.snap(2) == Box(0, 2, 10, 8)
    assert box.align(0.5, 0.5, 2, 2) == Box(0.5, 2.5, 10.5, 8.5)
    assert Box(0, 0, 1, 1).intersects(Box(1, 1, 2, 2)) and not Box(0, 0, 1, 1).intersects(Box(1.1, 1, 2, 2))
    assert GridSpec.gridding(Box(1, 1, 9, 9), 2, -2).bounds == Box(-2, -2, 12, 12)
    assert Box.parse(box.text()) == box
    spec = GridSpec(0, 10, 2, -2, 5, 5)
    assert GridSpec.from_json(spec.to_json()) == spec


def test_cells_are_truncated_and_packed(spark):
    spec = GridSpec(0.0, 100.0, 10.0, -10.0, 10, 10)
    r = spark.createDataFrame([(25.0, 71.0)], "x double, y double").select(spec.col(F.col("x")).alias("c"), spec.row(F.col("y")).alias("r"))
    assert tuple(r.first()) == (2, 2)
    col, row = unpack_cell(pack_cell(F.lit(7), F.lit(-3)))
    assert tuple(spark.range(1).select(col, row).first()) == (7, -3)


def test_radius_join_on_the_lattice(spark, lattice):
    spec = GridSpec(99.5, 199.5, 1.0, -1.0, 100, 100)
    got = {(r["row"], r["col"]): r["count"] for r in gridding.rasterize(lattice, spec, {}, 10.0).collect()}
    inside = sum(1 for i in range(-10, 11) for j in range(-10, 11) if i * i + j * j <= 100)
    assert got[(50, 50)] == inside == 317
    assert got[(0, 0)] == sum(1 for i in range(11) for j in range(11) if i * i + j * j <= 100)


def test_closed_cells_share_edges(spark):
    spec = GridSpec(0.0, 2.0, 1.0, -1.0, 2, 2)
    p = spark.createDataFrame([(1.0, 1.0, 5.0)], "x double, y double, z double")
    assert gridding.rasterize(p, spec, {}, 0).count() == 4
    assert gridding.to_cells(p, spec).count() == 1


def test_aggregates_against_numpy(spark):
    values = np.random.default_rng(0).normal(10, 3, 101)
    df = spark.createDataFrame([(float(v), float(i % 7)) for i, v in enumerate(values)], "z double, d2 double")
    z = F.col("z")
    r = df.agg(A.skewness(z).alias("s"), A.kurtosis(z).alias("k"), A.percentile(z, 0.85).alias("p"), A.idw(z, F.col("d2") + 1).alias("i"), A.variation(z).alias("v"), A.percentile(z, 0).alias("lo"), A.percentile(z, 1).alias("hi")).first()
    s = values.std(ddof=1)
    assert math.isclose(r["s"], ((values - values.mean()) ** 3).mean() / s**3) and math.isclose(r["k"], ((values - values.mean()) ** 4).mean() / s**4 - 3)
    assert r["p"] == np.sort(values)[int(100 * 0.85)] and (r["lo"], r["hi"]) == (values.min(), values.max())
    w = (1 / (np.arange(101) % 7 + 1.0)) ** 2
    assert math.isclose(r["i"], (w * values).sum() / w.sum()) and math.isclose(r["v"], s / values.mean())
    assert df.agg(A.idw(z, F.col("d2"))).first()[0] == df.where("d2 = 0").agg(F.max("z")).first()[0]
    empty = df.where("z > 1e9").agg(A.percentile(z, 0.5), A.skewness(z), A.gap_fraction(z, z), A.height_quantiles(z)).first()
    assert tuple(empty) == (None, None, 1.0, None)


def test_ranked_percentiles_equal_the_gathered_ones(spark):
    df = spark.createDataFrame([(i % 3, None if i % 11 == 0 else float(i * 7 % 50)) for i in range(200)], "g int, z double")
    a = gridding.ranked_percentiles(df, ["g"], "z", {"p": 0.85, "m": 0.5})
    b = df.groupBy("g").agg(A.percentile(F.col("z"), 0.85).alias("p"), A.median(F.col("z")).alias("m"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_filter_grammar():
    f = filters.parse("-f:max:c=2,5;l;minz=3;a=-5,5")
    assert f.method == "max" and f.classes == (2, 5) and f.last and f.z == (3.0, None) and f.angle == (-5.0, 5.0) and f.z_bounds() == (3.0, math.inf)
    with pytest.raises(ValueError):
        filters.parse("q=1")


def test_knn_on_the_lattice(spark, lattice):
    q = spark.createDataFrame([(1, 150.0, 150.2), (2, 99.0, 99.0), (3, None, 1.0)], "q long, x double, y double")
    got = [tuple(r) for r in joins.knn(q, "q", lattice, "point_id", ["x", "y"], 3, leaf_rows=500).orderBy("query_id", "rank").select("query_id", "id", F.round("d2", 6)).collect()]
    assert got == [(1, 5050, 0.04), (1, 5150, 0.64), (1, 5049, 1.04), (2, 0, 2.0), (2, 1, 5.0), (2, 100, 5.0)]
    assert joins.knn(q, "q", lattice.limit(2), "point_id", ["x", "y"], 5).count() == 4
    assert {tuple(r) for r in joins.range_count(q, "q", lattice, "point_id", ["x", "y"], 1.0).collect()} == {(1, 2), (2, 0), (3, 0)}


@pytest.mark.parametrize("chunk", [None, 3.0])
def test_as_of(spark, chunk):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 0.5), (3, "b", 9.0), (4, None, 5.0), (5, "a", None), (6, "a", 20.0)], "id long, g string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 50), ("a", 5.0, 51), ("a", 6.0, 60), ("b", 10.0, 1)], "g string, t double, v int")
    back = dict(joins.as_of(left, right, ["g"], "t", ["v"], chunk=chunk).select("id", "v_as_of").collect())
    assert back == {1: 51, 2: None, 3: None, 4: None, 5: None, 6: 60}
    ahead = dict(joins.as_of(left, right, ["g"], "t", ["v"], forward=True, chunk=chunk).select("id", "v_as_of").collect())
    assert ahead == {1: 51, 2: 10, 3: 1, 4: None, 5: None, 6: None}


def test_raster_windows_and_stack(spark):
    r = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 2.0)], "band int, row int, col int, value double")
    spec = GridSpec(0, 2, 1, -1, 2, 2)
    got = {(x["row"], x["col"]): x["value"] for x in raster.window(r, spec, -1, 0, 3, 2, -7.0).collect()}
    assert got == {(0, -1): -7.0, (1, -1): -7.0, (0, 0): 1.0, (1, 0): None, (0, 1): None, (1, 1): 2.0}
    both, stacked = raster.stack([(spec, r), (spec, r)])
    assert both.bands == 2 and stacked.count() == 4
    with pytest.raises(ValueError):
        raster.stack([(spec, r), (GridSpec(0, 2, 1, -1, 3, 2), r)])
    assert raster.tiles(r, 1, 1).where("tile_row = 0 and tile_col = 0").count() == 2
    assert raster.convert(r.withColumn("value", F.lit(300.0)), "Byte").first()["value"] is None


def test_morton(spark):
    m = sorting.morton(F.lit(5), F.lit(3))
    assert spark.range(1).select(m).first()[0] == 0b011011
    assert spark.range(1).select(sorting.morton(F.lit(2**31 - 1), F.lit(0), 31)).first()[0] == int("01" * 31, 2)


def test_registration_finds_a_known_motion(spark, lattice):
    few = lattice.where("x < 110 and y < 112").withColumn("z", F.sin(F.col("x")) * 3 + F.cos(F.col("y")) * 2)
    moved = few.withColumns({"x": F.col("x") + 0.2, "y": F.col("y") - 0.1, "z": F.col("z") + 0.05})
    done, fitness, matrix = surface.register(moved, few, "point_id", 10)
    assert done and fitness < 1e-6 and np.allclose(matrix[:3, 3], [-0.2, 0.1, -0.05], atol=1e-3)


@pytest.mark.parametrize(("k", "radius", "leaf_rows"), [(5, None, 10**6), (5, None, 100), (3, 0.4, 100), (None, 0.5, 100), (900, None, 100)])
def test_knn_against_brute_force(spark, k, radius, leaf_rows):
    rng = np.random.default_rng(3)
    p = np.round(rng.random((800, 3)) * 4, 1)
    q = np.round(rng.random((60, 3)) * 4, 1)
    frame = lambda v: spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(v)], "id long, x double, y double, z double")
    got = {}
    for r in joins.knn(frame(q), "id", frame(p), "id", ["x", "y", "z"], k, radius, leaf_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for i, a in enumerate(q):
        d2 = ((p - a) ** 2).sum(1)
        order = np.lexsort((np.arange(len(p)), d2))
        want = [int(o) for o in order if radius is None or d2[o] <= radius * radius][:k]
        assert got.get(i, []) == want


@pytest.mark.parametrize("k", [4, None])
def test_knn_of_a_hot_place(spark, monkeypatch, k):
    monkeypatch.setattr(kdsplit, "hot_positions", lambda sample, least=0: np.array([[1.0, 1.0]]))
    points = spark.createDataFrame([(i, 1.0, 1.0) for i in range(40)] + [(50, 1.5, 1.0), (51, 9.0, 9.0)], "id long, x double, y double")
    got = joins.knn(points.where("id >= 39"), "id", points, "id", ["x", "y"], k, 1.0).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    near = [*range(40), 50]
    assert {r["query_id"]: r["ids"] for r in got} == {39: near[:k] if k else near, 50: [50, 0, 1, 2][1:] + [50] if k else near, 51: [51]}


@pytest.mark.parametrize("leaf_rows", [10**6, 60])
def test_embedding_search_is_exact_and_near_enough_with_an_error(spark, leaf_rows):
    rng = np.random.default_rng(4)
    v = (rng.normal(0, 1, (12, 24))[rng.integers(0, 12, 700)] * 3 + rng.normal(0, 0.5, (700, 24))).astype(np.float32)
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 24)], "id long, e array<float>")
    asks = df.where("id % 20 = 0")
    w = v.astype(float)
    exact = {int(q): [int(o) for o in np.lexsort((np.arange(700), ((w - w[q]) ** 2).sum(1)))[:6]] for q in range(0, 700, 20)}
    for error in (0.0, 1.0):
        got = {}
        for r in joins.embedding_knn(asks, df, "id", "e", 6, 24, error, leaf_rows).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        recall = np.mean([len(set(got[q]) & set(ids)) / 6 for q, ids in exact.items()])
        assert got == exact if error == 0 else recall >= 0.9
