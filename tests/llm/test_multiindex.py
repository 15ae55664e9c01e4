import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import multiindex
from geostrata.operators import kdsplit

NAN = float("nan")


def brute(p, ids, q, k):
    d = ((p - q) ** 2).sum(1)
    return ids[np.lexsort((ids, d))[:k]].tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 600), st.integers(1, 5), st.integers(1, 9), st.integers(0, 1000))
def test_search_is_exact(n, dims, k, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.normal(0, 1, (n, dims)), 1)
    ids = rng.permutation(n)
    index = multiindex.MultiIndex(p, ids)
    assert sum(b - a for a, b in index.lists.values()) == n  # every vector is in a list
    for q in rng.normal(0, 1.5, (5, dims)):
        assert index.search(q, k)[0].tolist() == brute(p, ids, q, k)


@pytest.mark.parametrize("leaf_rows", [60, 100_000])
def test_nearest(spark, leaf_rows):
    rng = np.random.default_rng(5)
    p = rng.random((500, 3)) * [100, 100, 10]
    points = spark.createDataFrame([(int(i), *map(float, v), "s", 1) for i, v in enumerate(p)] + [(3, *map(float, p[3]), "s", 1), (900, None, 0.0, 0.0, "", 0), (901, NAN, 0.0, 0.0, "", 0)], "point_id long, x double, y double, z double, leaf string, id int")
    asks = [(1, 50.0, 50.0, 5.0), (2, -900.0, 0.0, 0.0), (3, 0.0, 0.0, 99999.0), (4, None, 0.0, 0.0)]
    queries = spark.createDataFrame(asks, "probe_id long, x double, y double, z double")
    got = {}
    for r in multiindex.nearest(queries, "probe_id", points, "point_id", ["x", "y", "z"], 8, leaf_rows=leaf_rows).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {a[0]: brute(p, np.arange(500), np.array(a[1:]), 8) for a in asks[:3]}
    mine = multiindex.nearest(points.where("point_id = 3"), "point_id", points, "point_id", ["x", "y", "z"], 4, skip_self=True, leaf_rows=leaf_rows).orderBy("rank").collect()
    assert [r["id"] for r in mine] == brute(p, np.arange(500), p[3], 5)[1:]


def test_few_and_none(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "id long, x double, y double")
    assert multiindex.nearest(points, "id", points, "id", ["x", "y"], 8).count() == 4
    assert multiindex.nearest(points.limit(0), "id", points, "id", ["x", "y"], 8).count() == 0
    assert multiindex.nearest(points, "id", points.limit(0), "id", ["x", "y"], 8).count() == 0


def test_hot_place(spark, monkeypatch):
    monkeypatch.setattr(kdsplit, "hot_positions", lambda sample, least=0: np.array([[1.0, 1.0]]))
    points = spark.createDataFrame([(i, 1.0, 1.0) for i in range(60)] + [(99, 1.1, 1.0)], "id long, x double, y double")
    queries = spark.createDataFrame([(7, 1.2, 1.0)], "q long, x double, y double")
    got = multiindex.nearest(queries, "q", points, "id", ["x", "y"], 4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [99, 0, 1, 2]
