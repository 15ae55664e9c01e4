"""k-d splits of a point set into leaves, with halo copies, and close pairs within a leaf.

The first splits are fitted to a bounded sample of the rows (SAMPLE_ROWS, chosen by a hash of the id). Where there must be
more leaves than that sample can tell apart, the tasks of a grouped pass fit the splits below each of them to a sample of
its own. There are at most 2^MOST_DEPTH leaves, so that the splits, nine bytes each, are small enough to travel with a
task; beyond that leaves get larger. Every row is then routed to its leaf; leaves are numbered in tree order, so that
leaf >> n is an ancestor's number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 100_000
LEAF_ROWS = 50_000
#: A position held by at least so many rows of the sample is split off before routing; at most SAMPLE_ROWS / HOT_ROWS positions can be.
HOT_ROWS = 200
#: Levels of splits that are fitted on the driver.
TOP_DEPTH = 11
MOST_DEPTH = 21
#: Rows of the sample for each leaf, where tasks fit the splits.
FIT_ROWS = 64
_BUCKETS = 1 << 30


@dataclass(frozen=True)
class KdSplits:
    """Heap-ordered inner nodes: node i has the children 2i + 1 (below value on axis) and 2i + 2."""

    axis: np.ndarray
    value: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def locate(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] >= self.value[node])
        return node - (self.leaves - 1)

    def touching(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the closed box [low, high] of a row meets."""
        row, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        for _ in range(self.depth):
            axis, value = self.axis[node], self.value[node]
            left, right = low[row, axis] < value, high[row, axis] >= value
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (self.leaves - 1)


def _fit(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and values of median splits on the axis of the widest spread (5 % to 95 %)."""
    inner = (1 << depth) - 1
    axis, value = np.zeros(inner, np.int8), np.zeros(inner)
    parts = {0: sample}
    for node in range(inner):
        part = parts.pop(node, sample[:0])
        if len(part):
            ordered = np.sort(part, axis=0)
            at = int(np.argmax(ordered[int(0.95 * (len(part) - 1))] - ordered[int(0.05 * (len(part) - 1))]))
            axis[node] = at
            value[node] = (ordered[(len(part) - 1) // 2, at] + ordered[len(part) // 2, at]) / 2
        below = part[:, axis[node]] < value[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[below], part[~below]
    return axis, value


def fit_splits(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, points: DataFrame | None = None, key: str = "id", columns: list[str] | None = None, to_space: Callable[[np.ndarray], np.ndarray] | None = None) -> KdSplits:
    """Splits deep enough for leaves of about leaf_rows of rows.

    sample is in the space of the splits. With points, their key and columns (to_space maps them), splits below TOP_DEPTH
    are fitted by tasks; what comes back is the splits alone.
    """
    depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(rows, 1) / leaf_rows)))))
    if depth <= TOP_DEPTH or points is None:
        return KdSplits(*_fit(sample, depth), depth)
    top = KdSplits(*_fit(sample, TOP_DEPTH), TOP_DEPTH)
    below = depth - TOP_DEPTH

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
                at = to_space(at) if to_space else at
                yield pa.RecordBatch.from_arrays([pa.array(top.locate(at)), *[pa.array(np.ascontiguousarray(at[:, i])) for i in range(dims)]], names=["leaf", *names])

    def fit_below(held: pa.Table) -> pa.Table:
        axis, value = _fit(np.column_stack([held.column(n).to_numpy() for n in names]), below)
        return pa.table({"leaf": held.column("leaf").slice(0, 1), "axis": pa.array([axis.tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})

    dims = sample.shape[1]
    names = [f"s{i}" for i in range(dims)]
    some = points.where(F.pmod(F.xxhash64(F.lit(8), key), F.lit(_BUCKETS)) < int(_BUCKETS * min(1.0, FIT_ROWS * 2.0**depth / rows)))
    located = some.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(locate, "leaf long, " + ", ".join(f"{n} double" for n in names))
    fitted = located.groupBy("leaf").applyInArrow(fit_below, "leaf long, axis binary, value binary").toArrow()
    axis, value = np.zeros((1 << depth) - 1, np.int8), np.zeros((1 << depth) - 1)
    axis[: len(top.axis)], value[: len(top.value)] = top.axis, top.value
    node = np.arange((1 << below) - 1)
    level = np.log2(node + 1).astype(np.int64)
    for leaf, a, v in zip(*(fitted.column(n).to_pylist() for n in ("leaf", "axis", "value")), strict=True):
        at = (1 << (TOP_DEPTH + level)) - 1 + leaf * (1 << level) + (node + 1 - (1 << level))
        axis[at], value[at] = np.frombuffer(a, np.int8), np.frombuffer(v)
    return KdSplits(axis, value, depth)


class SampleReach:
    """Upper bounds on the distance of the k-th nearest of all rows from a place, by the sample alone.

    The bound is the distance of the k-th nearest of the sample rows in the place's leaf or, where that has fewer than k,
    in the smallest subtree around it that has so many. It is infinite only if the whole sample has fewer, or if there
    is one leaf anyway. Distances are taken between the sample's vectors, its own places unless others are given.
    """

    def __init__(self, sample: np.ndarray, splits: KdSplits, k: int, vectors: np.ndarray | None = None):
        home = splits.locate(sample) if len(sample) else np.zeros(0, np.int64)
        order = np.argsort(home, kind="stable")
        self.held, self.leaf, self.splits, self.k = (sample if vectors is None else vectors)[order], home[order], splits, k

    def __call__(self, at: np.ndarray, vectors: np.ndarray | None = None, block: int = 256) -> np.ndarray:
        """Squared bounds of places."""
        vectors = at if vectors is None else vectors
        reach2 = np.full(len(at), np.inf)
        if not self.splits.depth or len(self.held) < self.k:
            return reach2
        leaf = self.splits.locate(at)
        for one in np.unique(leaf):
            for up in range(self.splits.depth + 1):
                begin, end = np.searchsorted(self.leaf, [(one >> up) << up, ((one >> up) + 1) << up])
                if end - begin >= self.k:
                    break
            near, mine = self.held[begin:end], np.nonzero(leaf == one)[0]
            for first in range(0, len(mine), block):
                some = mine[first : first + block]
                step = vectors[some, None, :] - near[None, :, :]
                reach2[some] = np.partition((step * step).sum(2), self.k - 1, axis=1)[:, self.k - 1]
        return reach2


def present(*columns: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    kept = F.lit(True)
    for c in columns:
        kept = kept & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return kept


def bounded_sample(points: DataFrame, key: str, columns: list[str], size: int = SAMPLE_ROWS) -> tuple[int, np.ndarray]:
    """Number of rows, and about size distinct rows of columns chosen by a hash of key; a key delivered twice counts once."""
    rows = points.count()
    chosen = points if rows <= size else points.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(_BUCKETS)) < int(_BUCKETS * size / rows))
    got = chosen.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]).toArrow()
    keys = got.column("_key").to_numpy()
    values = np.column_stack([got.column(f"_v{i}").to_numpy() for i in range(len(columns))]) if len(keys) else np.zeros((0, len(columns)))
    _, first = np.unique(keys, return_index=True)
    return rows, values[first]


def hot_positions(sample: np.ndarray, least: int = HOT_ROWS) -> np.ndarray:
    if not len(sample):
        return sample
    values, counts = np.unique(sample, axis=0, return_counts=True)
    return values[counts >= least]


def split_hot(points: DataFrame, key: str, columns: list[str], hot: np.ndarray) -> tuple[DataFrame, DataFrame | None]:
    """Points with each hot position reduced to one row, the smallest key, and the membership (key, rep) of the hot rows.

    hot has at most SAMPLE_ROWS / HOT_ROWS rows, so it is broadcast. Without hot positions the points pass as they are.
    """
    if not len(hot):
        return points, None
    spark = points.sparkSession
    names = [f"_hot{i}" for i in range(len(columns))]
    positions = F.broadcast(spark.createDataFrame([tuple(map(float, p)) for p in hot], ", ".join(f"{n} double" for n in names)))
    on = [points[c] == positions[n] for c, n in zip(columns, names, strict=True)]
    rows = points.join(positions, on, "left_semi")
    rep = rows.groupBy(*columns).agg(F.min(key).alias("_rep"))
    members = rows.select(key, *columns).join(F.broadcast(rep), columns).select(key, "_rep").distinct()
    return points.join(positions, on, "left_anti").unionByName(rep.withColumnRenamed("_rep", key)), members


def route(points: DataFrame, key: str, columns: list[str], splits: KdSplits, reach: float, to_space=None) -> DataFrame:
    """(leaf, own, key, columns): each point in its leaf, and a copy (own false) in each other leaf within reach of it.

    to_space maps the columns into the space of the splits; reach is a distance there.
    """
    schema = f"leaf long, own boolean, {key} long, " + ", ".join(f"{c} double" for c in columns)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            space = to_space(values) if to_space else values
            row, leaf = splits.touching(space - reach, space + reach)
            own = leaf == splits.locate(space)[row]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(own), pa.array(keys[row])] + [pa.array(np.ascontiguousarray(values[row, i])) for i in range(len(columns))], names=["leaf", "own", key, *columns])

    return points.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(send, schema)


def leaf_stats(points: DataFrame, key: str, columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(leaf, depth, rows, low, high): the leaves that splits of points have, their level, rows and boxes. Points without all coordinates take no part; a key delivered again counts again."""
    names = [f"v{i}" for i in range(len(columns))]
    held = points.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    held = held.where(F.col("id").isNotNull() & present(*[F.col(n) for n in names]))
    rows, sample = bounded_sample(held, "id", names)
    splits = fit_splits(sample, rows, leaf_rows, held, "id", names)
    routed = route(held, "id", names, splits, 0.0).where("own")
    return routed.groupBy("leaf").agg(F.lit(splits.depth).alias("depth"), F.count(F.lit(1)).alias("rows"), F.array(*[F.min(n) for n in names]).alias("low"), F.array(*[F.max(n) for n in names]).alias("high"))


def build_tree(points: np.ndarray, bucket: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Order of the points by leaf, boxes by level, and the leaves' bounds in that order. The tree is complete and balanced."""
    n, dims = points.shape
    height = max(0, int(np.ceil(np.log2(n / bucket))))
    order = np.arange(n)
    for level in range(height):
        bound = (np.arange((1 << level) + 1) * n) >> level
        held = points[order]
        low, high = np.minimum.reduceat(held, bound[:-1]), np.maximum.reduceat(held, bound[:-1])
        axis = np.argmax(high - low, axis=1)
        sizes = np.diff(bound)
        of, pick = np.repeat(np.arange(1 << level), sizes), np.arange(1 << level)
        width = np.maximum(high - low, 1e-300)[pick, axis]
        # the place inside the segment may be rounded: boxes are taken from the points as they come to lie
        order = order[np.argsort(of + np.clip((held[np.arange(n), axis[of]] - low[pick, axis][of]) / width[of], 0, 1) * 0.999, kind="stable")]
    bound = (np.arange((1 << height) + 1) * n) >> height
    held = points[order]
    boxes = [(np.minimum.reduceat(held, bound[:-1]), np.maximum.reduceat(held, bound[:-1]))]
    for _ in range(height):
        low, high = boxes[0]
        boxes.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
    return order, boxes, bound


def pairs_within(points: np.ndarray, radius2: float, bucket: int = 8, block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs whose squared distance is at most radius2, by a k-d tree walked against itself."""
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, boxes, bound = build_tree(points, bucket)
    a = b = np.zeros(1, np.int64)
    for low, high in boxes[1:]:
        same = a == b
        a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a[~same] + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, 2 * b[~same]])
        gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))
        near = (gap * gap).sum(1) <= radius2
        a, b = a[near], b[near]
    sizes = np.diff(bound)
    most = int(sizes.max())
    slot = np.arange(most)
    index = bound[:-1, None] + np.minimum(slot[None, :], sizes[:, None] - 1)
    filled = slot[None, :] < sizes[:, None]
    held = points[order]
    upper = slot[:, None] < slot[None, :]
    found_a, found_b = [], []
    for start in range(0, len(a), block):
        pa_, pb = a[start : start + block], b[start : start + block]
        left, right = held[index[pa_]], held[index[pb]]
        distance2 = np.zeros((len(pa_), most, most))
        for axis in range(points.shape[1]):
            step = left[:, :, None, axis] - right[:, None, :, axis]
            distance2 += step * step
        hit = (distance2 <= radius2) & filled[pa_][:, :, None] & filled[pb][:, None, :]
        hit &= (pa_ != pb)[:, None, None] | upper[None]
        which, i, j = np.nonzero(hit)
        found_a.append(order[index[pa_[which], i]])
        found_b.append(order[index[pb[which], j]])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
