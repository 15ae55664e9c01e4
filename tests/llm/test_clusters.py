import numpy as np
import pytest

from geostrata.llm import clusters
from geostrata.operators import kdsplit

NAN = float("nan")
SCHEMA = "point_id long, x double, y double, z double, id string, name int, affinity double"


def components(p, radius2):
    n = len(p)
    label = np.arange(n)
    a, b = np.nonzero(np.triu(((p[:, None] - p[None]) ** 2).sum(2) <= radius2, 1))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def frame(spark, ids, p):
    return spark.createDataFrame([(int(i), *map(float, q), "s", 1, 0.5) for i, q in zip(ids, p, strict=True)], SCHEMA)


@pytest.mark.parametrize("leaf_rows", [40, 100_000])
def test_clusters_are_the_chains_of_links(spark, leaf_rows):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.random((500, 3)) * [30, 30, 3], np.column_stack([np.arange(200) * 0.9, np.full(200, 15.0), np.zeros(200)])])
    ids = rng.permutation(len(p)) + 1000
    want = components(p, 1.12)
    smallest = {c: ids[want == c].min() for c in np.unique(want)}
    size = np.bincount(want)[want]
    got = clusters.cluster(frame(spark, ids, p), "point_id", ["x", "y", "z"], 1.12, 5, leaf_rows).collect()
    assert {(r["cluster_id"], r["id"], r["size"]) for r in got} == {(smallest[c], i, s) for c, i, s in zip(want, ids, size, strict=True) if s >= 5}
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    affinity = np.where(d2 <= 1.12, np.exp(-2 * d2 / 1.12), 0).sum(1) - 1
    by_id = dict(zip(ids.tolist(), affinity, strict=True))
    assert all(abs(r["affinity"] - by_id[r["id"]]) < 1e-9 for r in got)


def linked_sets(n, a, b):
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def same_sets(got, want):
    return len(np.unique(np.column_stack([got, want]), axis=0)) == len(np.unique(got)) == len(np.unique(want))


def graphs():
    rng = np.random.default_rng(7)
    for n, links in ((1, 0), (2, 1), (300, 299), (3000, 2600), (900, 4000)):
        a, b = (np.arange(n - 1), np.arange(1, n)) if n == 300 else (rng.integers(0, n, links), rng.integers(0, n, links))
        a, b = a[a != b], b[a != b]
        yield n, a, b, rng.random(len(a)) + 0.1


def test_clusters_of_whatever_shape():
    for n, a, b, w in graphs():
        assert same_sets(clusters.spectral_clusters(n, a, b, w, np.arange(n)), linked_sets(n, a, b))


def test_weights_of_very_different_size():
    rng = np.random.default_rng(8)
    n, a, b, w = next(g for g in graphs() if g[0] == 3000)
    assert same_sets(clusters.spectral_clusters(n, a, b, 10 ** (rng.random(len(a)) * 6), np.arange(n)), linked_sets(n, a, b))


@pytest.mark.parametrize("ablation", ["zero vectors", "no steps"])
def test_the_embedding_decides(monkeypatch, ablation):
    """Without start values all linked points look alike; without steps none do, which is an error."""
    n, a, b, w = next(g for g in graphs() if g[0] == 3000)
    if ablation == "zero vectors":
        monkeypatch.setattr(clusters, "start_vectors", lambda ids: np.zeros((4, len(ids))))
        assert not same_sets(clusters.spectral_clusters(n, a, b, w, np.arange(n)), linked_sets(n, a, b))
    else:
        monkeypatch.setattr(clusters, "iterate", lambda i, j, w, vectors, combined: vectors)
        with pytest.raises(RuntimeError):
            clusters.spectral_clusters(n, a, b, w, np.arange(n))


def test_kmeans_finds_the_values_of_the_vectors():
    rng = np.random.default_rng(9)
    centre = rng.random((4, 500))
    of = rng.integers(0, 500, 4000)
    assert same_sets(clusters.kmeans(centre[:, of] + rng.normal(0, 1e-9, (4, 4000))), of)


def test_dirty_rows(spark):
    rows = [(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0), (3, 0.5, 0.0, 0.0), (4, None, 0.0, 0.0), (5, 0.0, NAN, 0.0), (6, 0.0, 0.0, float("inf")), (7, 90.0, 0.0, 0.0)]
    df = spark.createDataFrame([(*r, "", 0, 0.0) for r in rows] + [(None, 0.0, 0.0, 0.0, "", 0, 0.0)], SCHEMA)
    got = {tuple(r) for r in clusters.cluster(df, "point_id", ["x", "y", "z"], 1.12).select("cluster_id", "id", "size").collect()}
    assert got == {(1, 1, 3), (1, 2, 3), (1, 3, 3), (7, 7, 1)}
    assert clusters.cluster(df.limit(0), "point_id", ["x", "y", "z"], 1.12).count() == 0


def test_hot_place(spark, monkeypatch):
    monkeypatch.setattr(kdsplit, "hot_positions", lambda sample, least=0: np.array([[1.0, 1.0, 1.0]]))
    df = spark.createDataFrame([(i, 1.0, 1.0, 1.0, "", 0, 0.0) for i in range(50)] + [(99, 1.5, 1.0, 1.0, "", 0, 0.0), (100, 50.0, 1.0, 1.0, "", 0, 0.0)], SCHEMA)
    got = {tuple(r) for r in clusters.cluster(df, "point_id", ["x", "y", "z"], 1.12, 3).select("cluster_id", "id", "size").collect()}
    assert got == {(0, i, 51) for i in [*range(50), 99]}


def test_description(spark):
    p = np.array([[0, 0, 0], [1, 0, 0], [-1, 0, 0], [9, 0, 0]], float)
    got = clusters.describe(clusters.cluster(frame(spark, [4, 5, 6, 7], p), "point_id", ["x", "y", "z"], 1.12), 2).orderBy("cluster_id").collect()
    assert [tuple(r) for r in got] == [(4, 3, [4, 5]), (7, 1, [7])]


@pytest.mark.parametrize("leaf_rows", [30, 100_000])
def test_hot_place_has_the_affinities_of_any_other(spark, monkeypatch, leaf_rows):
    rng = np.random.default_rng(9)
    p = np.vstack([np.full((50, 3), 1.0), [[1.5, 1.0, 1.0]] * 2, 1.0 + rng.random((60, 3)) * 3, [[50.0, 1.0, 1.0]]])
    ids = rng.permutation(len(p)) + 1
    df = frame(spark, [*ids, ids[0]], np.vstack([p, p[:1]]))  # one key delivered again
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    want = dict(zip(ids.tolist(), np.where(d2 <= 1.12, np.exp(-2 * d2 / 1.12), 0).sum(1) - 1, strict=True))
    for hot in (np.zeros((0, 3)), np.array([[1.0, 1.0, 1.0]])):
        monkeypatch.setattr(kdsplit, "hot_positions", lambda sample, least=0, hot=hot: hot)
        got = {r["id"]: r["affinity"] for r in clusters.cluster(df, "point_id", ["x", "y", "z"], 1.12, 1, leaf_rows).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - a) < 1e-9 for i, a in want.items())
