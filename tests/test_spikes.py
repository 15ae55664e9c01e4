import numpy as np
import pytest

from geostrata.operators import spikes
from geostrata.operators.spikes import LIMIT, excursions, judge, run_lengths

LIMITS = {"z": (-500.0, 9000.0)}


def judged(spark, rows, **options):
    df = spark.createDataFrame(rows, "point_id long, file_id int, gps_time double, z double, source string, _key string")
    return {(r["reading_id"], r["impossible"], r["stuck"], r["spike"] > 0) for r in judge(df, "point_id", "file_id", "gps_time", LIMITS, **options).collect()}


def series(values, source=1, first=0):
    return [(first + i, source, float(i), None if v is None else float(v), "s", "k") for i, v in enumerate(values)]


def test_each_kind(spark):
    rng = np.random.default_rng(1)
    z = (50 + np.cumsum(rng.normal(0, 0.3, 400))).tolist()
    z[40] += 60
    for i in (80, 81, 82):
        z[i] -= 45 + i % 3
    z[120] = -32768.0
    z[200:209] = [z[200]] * 9
    z[260] = None
    z[261] = float("nan")
    for i in range(300, 340):  # a building: the level stays
        z[i] += 3
    got = judged(spark, series(z))
    assert {g[0] for g in got if g[3]} == {40, 80, 81, 82}
    assert {g[0] for g in got if g[1]} == {120}
    assert {g[0] for g in got if g[2]} == set(range(200, 209))


def test_deliveries_ties_and_no_sources(spark):
    rows = series([1, 1, 1, 1, 1, 1, 1])
    assert judged(spark, rows + rows) == set()  # seven readings, delivered twice, are not fourteen
    assert judged(spark, series([1] * 8)) == {(i, False, True, False) for i in range(8)}
    assert judged(spark, []) == set()
    assert judged(spark, [(1, None, 1.0, 99999.0, "", ""), (2, 1, None, 99999.0, "", ""), (None, 1, 1.0, 99999.0, "", ""), (3, 1, 1.0, None, "", "")]) == set()
    assert judged(spark, [(1, 1, 1.0, 99999.0, "", ""), (2, 1, 2.0, float("inf"), "", "")]) == {(1, True, False, False), (2, True, False, False)}


def test_sources_are_judged_by_themselves(spark):
    rng = np.random.default_rng(2)
    calm, rough = (np.cumsum(rng.normal(0, s, 300)) for s in (0.01, 5.0))
    calm[100] += 2
    rough[100] += 2
    got = judged(spark, series(calm, 1) + series(rough, 2, 1000))
    assert {g[0] for g in got} == {100}


@pytest.mark.parametrize("block_rows", [500, 10**9])
def test_blocks_leave_no_trace(spark, block_rows):
    rng = np.random.default_rng(3)
    z = np.cumsum(rng.normal(0, 0.2, 4000))
    for i in rng.choice(np.arange(10, 3990, 12), 40, replace=False):
        if not 990 < i < 1040:
            z[i : i + rng.integers(1, 6)] += 30 + rng.random() * 50
    z[1000:1030] = z[1000]
    got = judged(spark, series(z), block_rows=block_rows, halo_rows=200)
    height = excursions(z)
    change = np.abs(np.diff(z))
    stuck = run_lengths(z) >= 8
    normal = change[(np.maximum(height[1:], height[:-1]) < 20) & ~stuck[1:] & ~stuck[:-1]].max()
    want = {i for i in range(len(z)) if height[i] > LIMIT * normal or stuck[i]}
    assert {g[0] for g in got} == want


def test_excursions_against_the_definition():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, 60).astype(float)
    best = np.zeros(60)
    for length in range(1, 6):
        for start in range(1, 60 - length):
            a, b = x[start - 1], x[start + length]
            h = min(min(abs(v - a), abs(v - b)) if (v > a) == (v > b) else 0.0 for v in x[start : start + length])
            best[start : start + length] = np.maximum(best[start : start + length], h)
    assert (excursions(x) == best).all()


def test_slopes_between_levels_are_no_spikes(spark):
    z = [10.0] * 7 + [10.1] * 7 + [12.5, 15.5] + [17.0, 17.1] * 30 + [15.0, 12.0] + [10.0, 10.1] * 30
    z[40] = 90.0
    assert {g[0] for g in judged(spark, series(z)) if g[3]} == {40}


def test_many_disturbed_changes(spark):
    """Single spikes at 7.5 % of the readings disturb 15 % of the changes, so the 0.9 quantile of all changes is a spike's."""
    rng = np.random.default_rng(6)
    z = np.cumsum(rng.normal(0, 0.2, 4000))
    at = np.arange(20, 3980, 13)
    z[at] += (30 + rng.random(len(at)) * 20) * rng.choice([-1, 1], len(at))
    assert np.quantile(np.abs(np.diff(z)), 0.9) > 25
    assert {g[0] for g in judged(spark, series(z)) if g[3]} == set(at.tolist())


def test_one_bad_block(spark):
    """A block that is full of spikes sets no limit for the rest of its source."""
    rng = np.random.default_rng(7)
    z = np.cumsum(rng.normal(0, 0.2, 4000))
    at = np.r_[np.arange(1500, 2000, 13), 300, 3300]
    z[at] += 40
    assert {g[0] for g in judged(spark, series(z), block_rows=500, halo_rows=200) if g[3]} == set(at.tolist())


def test_coarse_readings_have_a_scale(spark):
    rng = np.random.default_rng(8)
    z = np.full(2000, 50.0)
    z[rng.choice(np.arange(10, 1990), 200, replace=False)] += 0.1
    z[1000] = 90.0
    assert {g[0] for g in judged(spark, series(z)) if g[3]} == {1000}


@pytest.mark.parametrize("n", range(8, 21))
def test_short_sources(spark, n):
    z = [10 + 0.1 * (i % 2) for i in range(n)]
    z[n // 2] += 50
    assert {g[0] for g in judged(spark, series(z)) if g[3]} == {n // 2}


def test_sixty_six_spikes_in_a_thousand(spark):
    rng = np.random.default_rng(9)
    z = np.cumsum(rng.normal(0, 0.1, 1000))
    at = np.arange(10, 1000, 15)
    z[at] += 50
    assert len(at) == 66 and {g[0] for g in judged(spark, series(z)) if g[3]} == set(at.tolist())


@pytest.mark.parametrize("block_rows", [300, 1000, 2000, 10**9])
def test_blocks_of_unlike_disturbance(spark, block_rows):
    """129 spikes in the second half of a source: 13 % of the changes there, none before."""
    rng = np.random.default_rng(10)
    z = np.cumsum(rng.normal(0, 0.1, 4000))
    at = 2000 + np.arange(129) * 15 + 7
    z[at] += (30 + rng.random(129) * 30) * rng.choice([-1, 1], 129)
    assert {g[0] for g in judged(spark, series(z), block_rows=block_rows, halo_rows=100) if g[3]} == set(at.tolist())


def test_what_blocks_say_is_merged_without_loss():
    rng = np.random.default_rng(11)
    z = np.cumsum(rng.normal(0, 0.1, 9000))
    z[rng.choice(8000, 300, replace=False) + 500] += 40
    whole = spikes.judge_block(z, np.ones(len(z), bool), -500, 9000)[4]
    parts = []
    for begin in range(0, 9000, 1000):
        low, high = max(0, begin - 300), min(9000, begin + 1300)
        at = np.arange(low, high)
        parts += spikes.judge_block(z[low:high], (at >= begin) & (at < begin + 1000), -500, 9000)[4]
    flat = lambda said: [np.concatenate(c) for c in zip(*[(np.full(len(a), k), a, b) for k, a, b in said], strict=True)]
    one, many = spikes.merge_said(*flat(whole)), spikes.merge_said(*flat(parts))
    assert all(k == q and np.array_equal(a, c) and np.array_equal(b, d) for (k, a, b), (q, c, d) in zip(one, many, strict=True))


def test_the_chart_decides(spark, monkeypatch):
    """Without what the chart says no spike is found, and one that suspects nothing leaves the spikes among the normal changes."""
    rng = np.random.default_rng(12)
    z = np.cumsum(rng.normal(0, 0.2, 300))
    z[100] += 40
    field = np.ones(300, bool)
    found = spikes.judge_block(z, field, -500, 9000)
    assert list(np.nonzero(found[3] > 20)[0]) == [100]
    monkeypatch.setattr(spikes, "control_chart", lambda changes: (np.zeros(len(changes)), np.zeros(len(changes), bool)))
    assert not (spikes.judge_block(z, field, -500, 9000)[3] > 0).any()
