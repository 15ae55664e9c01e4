"""Percentiles of large numeric columns by merging centroid digests (t-digests), with certified rank errors.

A digest is a list of centroids (mean, weight, least and largest value of its own) in order of the mean. Sorted values
are clustered from the left: a centroid takes values as long as the scale function k(q) = compression / (2 pi) *
asin(2 q - 1) grows by at most 1 over it, so that centroids are small near the ends. Digests of partitions or days are
merged by clustering all their centroids again. However often that is done, a centroid's values lie between its own least
and largest one, so a value's rank is certain but for the weight of the centroids that it falls into; a second pass over
the data that counts the values below and at given thresholds settles what the digests leave open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPRESSION = 200.0
#: What infinite values count as, so that their means are numbers.
ENDLESS = 1e150
#: Salts that the rows of a group are spread over where they meet its thresholds.
SALTS = 32
#: With more partitions than this, digests of a group are merged in so many parts before they are merged into one.
FAN = 128
_ARRAYS = ("means", "weights", "lows", "highs")
_DIGEST = "count long, " + ", ".join(f"{n} array<double>" for n in _ARRAYS)

#: (count, means, weights, lows, highs)
Digest = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def recluster(means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray, compression: float = COMPRESSION) -> tuple[np.ndarray, ...]:
    """Centroids of sorted centroids under the size function."""
    if not len(means):
        return means.astype(float), weights.astype(float), lows.astype(float), highs.astype(float)
    total = weights.sum()
    right = np.cumsum(weights)
    scale = compression / (2 * np.pi)
    k_right = scale * np.arcsin(np.clip(2 * right / total - 1, -1, 1))
    starts = [0]
    n = len(means)
    at, left = 0, 0.0
    while True:
        k_left = scale * np.arcsin(min(1.0, max(-1.0, 2 * left / total - 1)))
        end = int(np.searchsorted(k_right, k_left + 1, "right"))  # the first that doesn't fit any more
        end = max(end, at + 1)
        if end >= n:
            break
        starts.append(end)
        at, left = end, right[end - 1]
    sums, sizes = np.add.reduceat(means * weights, starts), np.add.reduceat(weights, starts)
    return sums / sizes, sizes, np.minimum.reduceat(lows, starts), np.maximum.reduceat(highs, starts)


def digest_of(values: np.ndarray, compression: float = COMPRESSION) -> Digest:
    held = np.sort(values)
    return len(held), *recluster(held, np.ones(len(held)), held, held, compression)


def merge(parts: list[Digest], compression: float = COMPRESSION) -> Digest:
    if len(parts) == 1:
        return parts[0]
    arrays = [np.concatenate([p[k] for p in parts]) for k in range(1, 5)]
    order = np.argsort(arrays[0], kind="stable")
    return sum(p[0] for p in parts), *recluster(*(a[order] for a in arrays), compression)


def quantile(digest: Digest, q: np.ndarray) -> np.ndarray:
    """Values at the ranks q, by lines between the middles of the centroids."""
    count, means, weights, lows, highs = digest
    middle = np.cumsum(weights) - weights / 2
    return np.interp(np.asarray(q) * count, np.r_[0.0, middle, count], np.r_[lows.min(), means, highs.max()])


def rank(digest: Digest, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value, the estimated share of values at or below it, a share that certainly is at or below it, and one that what is below it certainly does not exceed."""
    count, means, weights, lows, highs = digest
    value = np.asarray(value, float)
    middle = np.cumsum(weights) - weights / 2
    least, most = lows.min(), highs.max()
    share = np.interp(value, np.r_[least, means, most], np.r_[0.0, middle, count]) / count
    share = np.where(value < least, 0.0, np.where(value >= most, 1.0, share))
    low = np.array([weights[highs <= v].sum() for v in value]) / count
    high = 1 - np.array([weights[lows >= v].sum() for v in value]) / count
    return share, low, high


def _unpack(batch: pa.Table) -> list[Digest]:
    arrays = []
    for name in _ARRAYS:
        column = batch.column(name).combine_chunks()
        ends = column.offsets.to_numpy()
        arrays.append(np.split(column.values.to_numpy(), ends[1:-1]) if ends[0] == 0 and len(ends) > 1 else [np.array(x) for x in column.to_pylist()])
    return list(zip(batch.column("count").to_pylist(), *arrays, strict=True))


def _pack(rows: list[Digest]) -> dict:
    out = {"count": pa.array([r[0] for r in rows], pa.int64())}
    for k, name in enumerate(_ARRAYS, 1):
        ends = np.cumsum([0, *(len(r[k]) for r in rows)])
        out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0), *(r[k] for r in rows)])))
    return out


def once(rows: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    """Each key once with its columns; of several deliveries any one, for they are the same. A null key stays as it is."""
    picked = rows.select(F.col(key).alias("_key"), *columns)
    names = picked.columns[1:]
    return picked.where(F.col("_key").isNotNull()).groupBy("_key").agg(*[F.first(n).alias(n) for n in names]).unionByName(picked.where(F.col("_key").isNull()))


def partial_digests(rows: DataFrame, group: str, fields: list[str], part: str | None = None, compression: float = COMPRESSION) -> DataFrame:
    """(group_id, part, field, digest): a digest of each group, field and part (a day, say) in each partition of the rows.

    Null and NaN values don't count, nor do rows of a null group; beyond ENDLESS a value counts as ENDLESS. A group of whatever size is read where it lies, so
    that only digests move.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        waiting: dict[str, list] = {f: [] for f in fields}
        rows_waiting = 0

        def digest_waiting() -> None:
            for f in fields:
                if not waiting[f]:
                    continue
                key, values = np.concatenate([k for k, _ in waiting[f]]), np.concatenate([v for _, v in waiting[f]])
                waiting[f].clear()
                order = np.argsort(key, kind="stable")
                key, values = key[order], values[order]
                starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else []
                for begin, end in zip(starts, np.r_[starts[1:], len(key)] if len(key) else [], strict=True):
                    held.setdefault((int(key[begin]), f), []).append(digest_of(values[begin:end], compression))

        codes: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            groups, parts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            pairs, at = np.unique(np.column_stack([groups, parts]), axis=0, return_inverse=True)
            code = np.array([codes.setdefault((int(g), int(p)), len(codes)) for g, p in pairs])[at.reshape(-1)]
            for i, f in enumerate(fields):
                value = np.clip(batch.column(2 + i).to_numpy(zero_copy_only=False), -ENDLESS, ENDLESS)
                there = ~np.isnan(value)
                waiting[f].append((code[there], value[there]))
            rows_waiting += batch.num_rows
            if rows_waiting >= 500_000:
                digest_waiting()
                rows_waiting = 0
        digest_waiting()
        names = list(codes)
        out = [(names[c], f, merge(d, compression) if len(d) > 1 else d[0]) for (c, f), d in held.items()]
        for begin in range(0, len(out), 2000):
            some = out[begin : begin + 2000]
            yield pa.RecordBatch.from_pydict({"group_id": pa.array([o[0][0] for o in some], pa.int64()), "part": pa.array([o[0][1] for o in some], pa.int32()), "field": pa.array([o[1] for o in some], pa.string())} | _pack([o[2] for o in some]))

    day = F.lit(0) if part is None else F.coalesce(F.unix_date(F.col(part).cast("date")), F.lit(-(2**31)))
    picked = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("g"), day.cast("int").alias("p"), *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(fields)])
    return picked.mapInArrow(send, f"group_id long, part int, field string, {_DIGEST}")


def merge_digests(digests: DataFrame, by: list[str], compression: float = COMPRESSION) -> DataFrame:
    """One digest for each value of by (some of group_id, part, field), of any number of digests from anywhere."""

    def one(held: pa.Table) -> pa.Table:
        return pa.table({b: held.column(b).slice(0, 1) for b in by} | _pack([merge(_unpack(held), compression)]))

    kinds = dict(digests.dtypes)
    spark = digests.sparkSession
    held = digests.select(*by, "count", *_ARRAYS)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by)
    if by and int(spark.conf.get("spark.sql.shuffle.partitions")) > FAN:
        # a hot group has a digest from each of many partitions: they are merged in FAN parts first
        fanned = held.withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(FAN)))
        held = fanned.groupBy(*by, "_fan").applyInArrow(one, f"{schema}, {_DIGEST}")
    if "part" in by:
        # digests of parts are small and many, so the number of tasks that merge them is not left to their size
        held = held.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
    return held.groupBy(*by).applyInArrow(one, f"{schema}, {_DIGEST}")


def percentiles(digests: DataFrame, pcts: list[int]) -> DataFrame:
    """(group_id, field, pct, value, count) of digests by group_id and field."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.array(pcts) / 100
        for batch in batches:
            held = pa.Table.from_batches([batch])
            groups, fields, parts = held.column("group_id").to_pylist(), held.column("field").to_pylist(), _unpack(held)
            m = len(pcts)
            yield pa.RecordBatch.from_pydict({
                "group_id": pa.array([g for g in groups for _ in range(m)], pa.int64()), "field": pa.array([f for f in fields for _ in range(m)], pa.string()), "pct": pa.array(pcts * len(groups), pa.int32()),
                "value": pa.array(np.concatenate([quantile(d, q) for d in parts]) if parts else [], pa.float64()), "count": pa.array([d[0] for d in parts for _ in range(m)], pa.int64()),
            })

    return digests.mapInArrow(read, "group_id long, field string, pct int, value double, count long")


def ranks(digests: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(group_id, field, value, share, low, high): the share at or below each threshold by the digest; at least low is at or below it, at most high is below it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.Table.from_batches([batch])
            values = held.column("value").to_numpy()
            found = [rank(d, values[i : i + 1]) for i, d in enumerate(_unpack(held))]
            yield pa.RecordBatch.from_pydict({"group_id": held.column("group_id").combine_chunks(), "field": held.column("field").combine_chunks(), "value": pa.array(values)} | {n: pa.array([float(f[k][0]) for f in found], pa.float64()) for k, n in enumerate(("share", "low", "high"))})

    wanted = thresholds.select(F.col("group_id").cast("long"), F.col("field").cast("string"), F.col("value").cast("double"))
    return wanted.join(digests, ["group_id", "field"]).mapInArrow(read, "group_id long, field string, value double, share double, low double, high double")


def count_at(rows: DataFrame, group: str, fields: list[str], thresholds: DataFrame, spread: str, salts: int = SALTS) -> DataFrame:
    """(group_id, field, value, below, at_or_below, count): the counting pass, exact, of each threshold of a group and field.

    The rows of a group are spread over salts by the column spread (a key), so that a hot group is no single task; a group's thresholds are one row
    of arrays, so that the join adds no rows. Counts are added up before they move.
    """
    arrays = thresholds.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("group_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(f"_t{i}") for i, f in enumerate(fields)])
    salted = arrays.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("group_id"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int").alias("_salt"), *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(fields)])
    met = held.join(salted, ["group_id", "_salt"])

    def place(i: int) -> Column:
        """Twice the number of thresholds below the value, and one more if the next one equals it; null if it isn't present."""
        value = F.col(f"_v{i}")
        steps = F.aggregate(f"_t{i}", F.lit(0), lambda n, t: n + F.when(t < value, 2).when(t == value, 1).otherwise(0))
        return F.when(value.isNotNull() & ~F.isnan(value), steps)

    # of each value all that counts is its place among the thresholds; the places are few
    counted = met.groupBy("group_id", *[place(i).alias(f"_p{i}") for i in range(len(fields))]).agg(F.count(F.lit(1)).alias("n"))
    places = counted.select("group_id", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_p{i}").alias("p")) for i, f in enumerate(fields)])).alias("_f")).select("group_id", "_f.field", "_f.p", "n").where("p is not null")
    places = places.groupBy("group_id", "field").agg(F.collect_list(F.struct("p", "n")).alias("places"), F.sum("n").alias("count"))
    ordered = arrays.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_t{i}").alias("t")) for i, f in enumerate(fields)])).alias("_f")).select("group_id", "_f.field", F.posexplode("_f.t").alias("k", "value"))
    met = ordered.join(places, ["group_id", "field"], "left")
    total = lambda keep: F.coalesce(F.aggregate(F.filter("places", lambda x: keep(x)), F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0).cast("long"))
    # a value below threshold k has a place of at most 2 k, one equal to it 2 k + 1
    return met.select("group_id", "field", "value", total(lambda x: x["p"] <= 2 * F.col("k")).alias("below"), total(lambda x: x["p"] <= 2 * F.col("k") + 1).alias("at_or_below"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))
