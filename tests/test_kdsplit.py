import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.operators import kdsplit


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 400), st.integers(1, 3), st.floats(0.001, 0.5), st.integers(0, 10_000))
def test_pairs_within_are_those_of_brute_force(n, dims, radius, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random((n, dims)), 2)  # with copies and ties
    a, b = kdsplit.pairs_within(p, radius * radius)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2) if n else np.zeros((0, 0))
    want = set(zip(*np.nonzero(np.triu(d2 <= radius * radius, 1)), strict=True))
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want and len(a) == len(want)


def test_routing_is_a_partition_with_halo():
    rng = np.random.default_rng(1)
    p = rng.random((5000, 2))
    splits = kdsplit.fit_splits(p[:500], len(p), 300)
    home = splits.locate(p)
    assert np.bincount(home, minlength=splits.leaves).max() < 900
    row, leaf = splits.touching(p - 0.01, p + 0.01)
    assert (np.bincount(row[leaf == home[row]], minlength=len(p)) == 1).all()
    near = {(r, x) for r, x in zip(row.tolist(), leaf.tolist(), strict=True)}
    a, b = kdsplit.pairs_within(p, 0.01**2)
    assert all((i, home[j]) in near and (j, home[i]) in near for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_splits_of_nothing_and_of_one_place():
    empty = kdsplit.fit_splits(np.zeros((0, 2)), 1_000_000)
    assert (empty.locate(np.ones((3, 2))) < empty.leaves).all()
    same = kdsplit.fit_splits(np.ones((100, 2)), 1_000_000)
    assert len(set(same.locate(np.ones((5, 2))).tolist())) == 1


def test_hot_positions():
    sample = np.vstack([np.random.default_rng(0).random((500, 2)), np.full((300, 2), 0.25)])
    assert kdsplit.hot_positions(sample, 200).tolist() == [[0.25, 0.25]]
    assert len(kdsplit.hot_positions(sample[:0])) == 0


def test_splits_below_the_top_are_fitted_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(kdsplit, "TOP_DEPTH", 2)
    monkeypatch.setattr(kdsplit, "FIT_ROWS", 40)
    rng = np.random.default_rng(6)
    p = rng.normal(0, 1, (6000, 2)) ** 3
    points = spark.createDataFrame([(int(i), *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double")
    splits = kdsplit.fit_splits(p[rng.random(6000) < 0.1], 6000, 100, points, "id", ["x", "y"])
    assert splits.depth == 6 and splits.axis.dtype == np.int8
    size = np.bincount(splits.locate(p), minlength=64)
    assert size.min() > 30 and size.max() < 250
    assert np.array_equal(splits.locate(p) >> 4, kdsplit.KdSplits(splits.axis[:3], splits.value[:3], 2).locate(p))


def test_fitting_many_leaves_costs_the_driver_little():
    splits = kdsplit.fit_splits(np.random.default_rng(7).random((100_000, 3)), 10**8)
    assert splits.depth == kdsplit.TOP_DEPTH and kdsplit.MOST_DEPTH <= 21


def test_reach_is_finite_with_few_sample_rows_a_leaf():
    rng = np.random.default_rng(8)
    sample, rows, k = rng.random((2000, 2)), rng.random((300_000, 2)), 8
    splits = kdsplit.KdSplits(*kdsplit._fit(rows[:65_536], 12), 12)  # 4096 leaves, of which most hold no row of the sample
    at = rng.random((300, 2))
    reach = np.sqrt(kdsplit.SampleReach(sample, splits, k)(at))
    assert np.isfinite(reach).all()
    row, _ = splits.touching(at - reach[:, None], at + reach[:, None])
    met = np.bincount(row, minlength=300)
    assert met.max() <= 60 * k * splits.leaves / len(sample) and met.mean() < splits.leaves / 20
    for a, r in zip(at[:50], reach, strict=False):
        assert (((rows - a) ** 2).sum(1) <= r * r).sum() >= k
