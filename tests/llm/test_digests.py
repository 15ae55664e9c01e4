import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geostrata.llm import digests

NAN = float("nan")


def true_share(values, v):
    return np.searchsorted(np.sort(values), v, "right") / len(values)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5000), st.integers(1, 8), st.sampled_from(["normal", "heavy", "few", "same"]), st.integers(0, 1000))
def test_merged_digests_keep_ranks(n, parts, kind, seed):
    rng = np.random.default_rng(seed)
    values = {"normal": rng.normal(0, 1, n), "heavy": rng.standard_cauchy(n), "few": rng.integers(0, 4, n).astype(float), "same": np.full(n, 3.0)}[kind]
    merged = digests.merge([digests.digest_of(p) for p in np.array_split(values, parts) if len(p)])
    assert merged[0] == n and np.isclose(merged[2].sum(), n) and merged[3].min() == values.min() and merged[4].max() == values.max()
    q = np.array([0.01, 0.25, 0.5, 0.75, 0.99])
    got = digests.quantile(merged, q)
    assert (np.diff(got) >= 0).all() and got.min() >= values.min() and got.max() <= values.max()
    if kind in ("normal", "heavy"):
        assert (np.abs(true_share(values, got) - q) <= 0.02 + 2 / n).all()
        share, low, high = digests.rank(merged, got)
        truth = true_share(values, got)
        assert (np.abs(share - truth) <= 0.02 + 2 / n).all()
    for v in (*got, *values[:5], values.min() - 1, values.max() + 1):
        share, low, high = (x[0] for x in digests.rank(merged, [v]))
        assert low <= (values <= v).mean() + 1e-12 and high >= (values < v).mean() - 1e-12


def test_bounds_hold_after_many_merges_and_are_narrow():
    rng = np.random.default_rng(6)
    values = rng.normal(0, 1, 64_000)
    parts = [digests.digest_of(p) for p in np.array_split(values, 64)]
    while len(parts) > 1:
        parts = [digests.merge(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    for v in rng.choice(values, 200):
        _, low, high = (x[0] for x in digests.rank(parts[0], [v]))
        assert low <= (values <= v).mean() + 1e-12 and high >= (values < v).mean() - 1e-12 and high - low < 0.12


def test_a_digest_is_small():
    merged = digests.merge([digests.digest_of(np.random.default_rng(i).normal(0, 1, 20_000)) for i in range(20)])
    assert len(merged[1]) <= 2 * digests.COMPRESSION


def test_counting_pass_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(g), None if i % 50 == 0 else float(z), None if i % 70 == 0 else int(k)) for i, (g, z, k) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(0, 30, 900) / 3, rng.integers(0, 9, 900), strict=True))]
    rows += [(2000, None, 1.0, 1), (2001, 1, NAN, 1)]
    df = spark.createDataFrame(rows, "id long, g int, z double, idx long")
    marks = spark.createDataFrame([(g, f, v) for g in range(4) for f in ("z", "idx") for v in (-1.0, 3.0, 10 / 3, 99.0)] + [(0, "z", None), (0, "z", NAN), (0, "z", 3.0)], "group_id int, field string, value double")
    got = {(r["group_id"], r["field"], r["value"]): (r["below"], r["at_or_below"], r["count"]) for r in digests.count_at(df, "g", ["z", "idx"], marks, "id").collect()}
    assert len(got) == 32
    for (g, f, v), (below, at, count) in got.items():
        held = np.array([r[2 if f == "z" else 3] for r in rows if r[1] == g and r[2 if f == "z" else 3] is not None], float)
        held = held[~np.isnan(held)]
        assert (below, at, count) == ((held < v).sum(), (held <= v).sum(), len(held))


def test_days_and_partitions_combine(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(50, 10, 3000)
    df = spark.createDataFrame([(int(i), 1, float(v), f"2024-03-0{1 + i % 4}", "x") for i, v in enumerate(z)], "id long, g int, z double, day string, part string").repartition(5)
    daily = digests.merge_digests(digests.partial_digests(df, "g", ["z"], "day"), ["group_id", "part", "field"])
    assert daily.count() == 4
    got = digests.percentiles(digests.merge_digests(daily, ["group_id", "field"]), [5, 50, 95]).collect()
    assert {r["count"] for r in got} == {3000}
    for r in got:
        assert abs(true_share(z, r["value"]) - r["pct"] / 100) < 0.01
    direct = digests.percentiles(digests.merge_digests(digests.partial_digests(df, "g", ["z"]), ["group_id", "field"]), [50]).first()
    assert abs(true_share(z, direct["value"]) - 0.5) < 0.01


def test_empty_null_and_endless(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, NAN), (3, None, 5.0), (4, 2, float("inf")), (5, 2, 1.0)], "id long, g int, z double")
    got = digests.percentiles(digests.merge_digests(digests.partial_digests(df, "g", ["z"]), ["group_id", "field"]), [50, 100]).collect()
    assert {r["group_id"] for r in got} == {2} and all(np.isfinite(r["value"]) for r in got)
    assert digests.partial_digests(df.limit(0), "g", ["z"]).count() == 0


def test_deliveries_count_once(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 6.0), (None, 7.0), (None, 7.0)], "id long, z double")
    assert sorted(r["z"] for r in digests.once(df, "id", "z").collect()) == [5.0, 6.0, 7.0, 7.0]
    assert digests.once(df, "id", F.col("z").alias("w")).columns == ["_key", "w"]


def test_merging_in_parts_gives_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(digests, "FAN", 2)
    z = np.random.default_rng(9).normal(0, 1, 4000)
    df = spark.createDataFrame([(int(i), int(i % 2), float(v)) for i, v in enumerate(z)], "id long, g int, z double").repartition(9)
    got = digests.percentiles(digests.merge_digests(digests.partial_digests(df, "g", ["z"]), ["group_id", "field"]), [50]).collect()
    assert sorted((r["group_id"], r["count"]) for r in got) == [(0, 2000), (1, 2000)]
    assert all(abs(true_share(z[r["group_id"] :: 2], r["value"]) - 0.5) < 0.01 for r in got)
