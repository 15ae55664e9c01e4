"""The k nearest of a collection of vectors for each of many query vectors, by an inverted multi-index.

The two halves of the vectors are quantised separately: k-means on a sample of a leaf's vectors gives each half its
centroids, and a vector's list in the index is the pair of its centroids. A query walks the pairs in the order of the
summed distance of its halves, by a heap, reranks the entries of each list by their true distance and stops when the next
sum cannot beat its k-th best. Distances to a centroid's list are taken to the box of its members, so that the sum is
a lower bound and the result exact.

The collection is cut into leaves by k-d splits, each leaf with an index of its own over all of its rows; the splits are
fitted to a bounded sample. The sample also bounds the distance of a query's k-th neighbour from above (see SampleReach),
and the query goes to every leaf that the bound reaches; the best k of all leaves are its result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kdsplit

TRAIN_ROWS = 4096
LLOYD = 4
#: Vectors for each list of the index, on average over the pairs of centroids.
LIST_ROWS = 16


def fit_centroids(values: np.ndarray, k: int, rounds: int = LLOYD, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    held = values if len(values) <= TRAIN_ROWS else values[rng.choice(len(values), TRAIN_ROWS, replace=False)]
    held = np.unique(held, axis=0)
    k = min(k, len(held))
    centroids = held[np.linspace(0, len(held) - 1, k).astype(int)] if held.shape[1] == 1 else held[rng.choice(len(held), k, replace=False)]
    for _ in range(rounds):
        at = nearest_centroid(held, centroids)
        size = np.bincount(at, minlength=k)
        moved = np.column_stack([np.bincount(at, held[:, d], k) for d in range(held.shape[1])])
        centroids = np.where(size[:, None] > 0, moved / np.maximum(size, 1)[:, None], centroids)
    return centroids


def nearest_centroid(values: np.ndarray, centroids: np.ndarray, block: int = 8192) -> np.ndarray:
    out = np.empty(len(values), np.int64)
    # distances are taken from the middle of the centroids in single precision: which list a vector is in may be any near one
    middle = centroids.mean(0)
    c = (centroids - middle).astype(np.float32)
    half = (c * c).sum(1) / 2
    for begin in range(0, len(values), block):
        v = (values[begin : begin + block] - middle).astype(np.float32)
        out[begin : begin + block] = np.argmax(v @ c.T - half, axis=1)
    return out


class MultiIndex:
    """Index over vectors (n x d). Its lists hold every vector."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, list_rows: int = LIST_ROWS):
        d = vectors.shape[1]
        self.split = (d + 1) // 2
        halves = vectors[:, : self.split], vectors[:, self.split :]
        lists = max(1, len(vectors) // list_rows)
        second = 1 if halves[1].shape[1] == 0 else max(1, int(np.ceil(lists ** (halves[1].shape[1] / d))))
        counts = max(1, lists // second), second
        at, self.low, self.high = [], [], []
        for half, k in zip(halves, counts, strict=True):
            if half.shape[1]:
                code = nearest_centroid(half, fit_centroids(half, k))
            else:
                code = np.zeros(len(half), np.int64)
            code = np.unique(code, return_inverse=True)[1]
            n = int(code.max()) + 1 if len(code) else 0
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(n))
            at.append(code)
            self.low.append(np.minimum.reduceat(half[order], starts) if n else half)
            self.high.append(np.maximum.reduceat(half[order], starts) if n else half)
        self.width = len(self.low[1])
        cell = at[0] * self.width + at[1]
        order = np.lexsort((ids, cell))
        self.vectors, self.ids = vectors[order], ids[order]
        cells, first = np.unique(cell[order], return_index=True)
        ends = np.r_[first[1:], len(cell)]
        self.lists = {int(c): (int(a), int(b)) for c, a, b in zip(cells, first, ends, strict=True)}

    def search(self, query: np.ndarray, k: int, reach2: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the k nearest within reach2, ties by id."""
        halves = query[: self.split], query[self.split :]
        order, distance = [], []
        for half, low, high in zip(halves, self.low, self.high, strict=True):
            gap = np.maximum(0, np.maximum(low - half, half - high))
            d2 = (gap * gap).sum(1)
            o = np.argsort(d2, kind="stable")
            order.append(o.tolist())
            distance.append(d2[o].tolist())
        (o1, o2), (d1, d2) = order, distance
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        worst = reach2
        heap = [(d1[0] + d2[0], 0, 0)] if d1 else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound > worst:
                break
            if j + 1 < len(d2):
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(d1):
                heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
            entry = self.lists.get(o1[i] * self.width + o2[j])
            if entry is None:
                continue
            step = self.vectors[entry[0] : entry[1]] - query
            true2 = (step * step).sum(1)
            near = true2 <= worst
            if near.any():
                ids, found = np.concatenate([ids, self.ids[entry[0] : entry[1]][near]]), np.concatenate([found, true2[near]])
                if len(found) > k:
                    best = np.lexsort((ids, found))[:k]
                    ids, found = ids[best], found[best]
                if len(found) == k:
                    worst = min(worst, float(found.max()))
        best = np.lexsort((ids, found))
        return ids[best], found[best]


def nearest(queries: DataFrame, query_key: str, points: DataFrame, key: str, columns: list[str], k: int, skip_self: bool = False, leaf_rows: int = kdsplit.LEAF_ROWS) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest points of each query, ties by id.

    Queries and points without all coordinates take no part; a key delivered again with the same values counts once. With
    fewer than k points a query gets them all. skip_self leaves out a point whose key is the query's. Of the points at a
    hot place (see kdsplit) the k (k + 1 with skip_self) smallest keys can be neighbours at all, so only they are
    indexed. No queries or no points give no rows. Other columns take no part.
    """
    names = [f"v{i}" for i in range(len(columns))]
    want = k + skip_self

    def places(df: DataFrame, id_: str) -> DataFrame:
        held = df.select(F.col(id_).cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
        return held.where(F.col("id").isNotNull() & kdsplit.present(*[F.col(n) for n in names]))

    held, asked = places(points, key), places(queries, query_key)
    rows, sample = kdsplit.bounded_sample(held, "id", names)
    splits = kdsplit.fit_splits(sample, rows, leaf_rows, held, "id", names)
    hot = kdsplit.hot_positions(sample)
    if len(hot):
        light, members = kdsplit.split_hot(held, "id", names, hot)
        few = members.withColumn("_n", F.row_number().over(Window.partitionBy("_rep").orderBy("id"))).where(F.col("_n") <= want).where("id <> _rep")
        at = light.join(F.broadcast(few.select(F.col("_rep"), F.col("id").alias("_id"))), F.col("id") == F.col("_rep"))
        held = light.unionByName(at.select(F.col("_id").alias("id"), *names))
    bound = kdsplit.SampleReach(sample, splits, want)

    def send_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            reach2 = bound(at)
            reach = np.sqrt(reach2) * (1 + 1e-9) + 1e-9
            row, to = splits.touching(at - reach[:, None], at + reach[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(0).take(pa.array(row)), pa.array((reach * reach)[row])] + [pa.array(np.ascontiguousarray(at[row, i])) for i in range(len(names))], names=["leaf", "id", "reach2", *names])

    columns_ = ", ".join(f"{n} double" for n in names)
    sent = asked.mapInArrow(send_query, f"leaf long, id long, reach2 double, {columns_}")
    routed = kdsplit.route(held, "id", names, splits, 0.0).where("own")

    def in_leaf(entries: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_id, out_d = [], [], []
        if len(entries) and len(asks):
            ids, first = np.unique(entries.column("id").to_numpy(), return_index=True)
            index = MultiIndex(np.column_stack([entries.column(n).to_numpy()[first] for n in names]), ids)
            query_ids, first = np.unique(asks.column("id").to_numpy(), return_index=True)
            at = np.column_stack([asks.column(n).to_numpy()[first] for n in names])
            reach2 = asks.column("reach2").to_numpy()[first]
            # queries at one place have the same reach and the same neighbours, so a place is searched once
            place, first, at_place = np.unique(at, axis=0, return_index=True, return_inverse=True)
            searched = [index.search(p, want, float(reach2[f])) for p, f in zip(place, first, strict=True)]
            for q, k_place in zip(query_ids, at_place.reshape(-1), strict=True):
                found, distance2 = searched[k_place]
                if skip_self:
                    other = found != q
                    found, distance2 = found[other][:k], distance2[other][:k]
                out_q.append(np.full(len(found), q))
                out_id.append(found)
                out_d.append(distance2)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": join(out_q, np.int64), "id": join(out_id, np.int64), "distance": np.sqrt(join(out_d, float))})

    found = routed.groupBy("leaf").cogroup(sent.groupBy("leaf")).applyInArrow(in_leaf, "query_id long, id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
