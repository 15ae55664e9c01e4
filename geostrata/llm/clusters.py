"""Clusters of mutually similar points, by power-iteration spectral clustering over sparse affinities.

Two points are linked if they are within a radius. The affinity of a link falls with the distance. The affinities of a
block of points (a leaf of k-d splits with a halo as wide as the radius) are normalised, and several vectors, whose
starting values come from a hash of the ids, are iterated by them until they differ by no more than TOLERANCE over any
link: plain steps first, then steps combined by conjugate gradients, so that a long thin cluster takes steps by its
length and not by its square. What a vector converges to is constant on each set of points joined by chains of links
and differs between them, and k-means over the values of all vectors finds these sets. Nothing else joins two points:
links say only whether the vectors have converged.

Two sets that are not linked are told apart as long as their values differ by more than APART in one of the vectors;
that they don't has a chance like that of equal 64-bit hashes.

Clusters that reach over the edge of a leaf go on as single points of the next graph, with the summed affinities between
them, whose blocks are eight sibling leaves each, up to the root of the splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import kdsplit
from ..session import cut

VECTORS = 4
#: Plain steps of the power iteration, before steps are combined.
STEPS = 8
#: Combined steps before converged clusters are taken out; each time there are twice as many.
FIRST_STEPS = 48
#: How much converged vectors may differ over a link.
TOLERANCE = 1e-8
#: Values further apart than this belong to different clusters.
APART = 1e-6
#: Levels of the splits that are joined at once.
LEVELS = 3


def start_vectors(ids: np.ndarray, vectors: int = VECTORS) -> np.ndarray:
    """Vectors of values in [0, 1) of each id, the same wherever the id turns up."""
    out = np.empty((vectors, len(ids)))
    for k in range(vectors):
        h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[k] = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return out


def _both_ways(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in both directions, those between the same two ends summed, sorted by the first end."""
    code, at = np.unique(np.concatenate([a * n + b, b * n + a]), return_inverse=True)
    return code // n, code % n, np.bincount(at, np.concatenate([w, w]), len(code))


def iterate(i: np.ndarray, j: np.ndarray, w: np.ndarray, vectors: np.ndarray, combined: int, plain: int = STEPS) -> np.ndarray:
    """vectors (k x n) after so many steps of the normalised affinities.

    Links are in both directions and sorted by i, and every point has one. A plain step moves the vectors half way to the
    means of their neighbours; conjugate gradients combine further steps to the least error.
    """
    starts = np.searchsorted(i, np.arange(vectors.shape[1]))
    root = np.sqrt(np.add.reduceat(w, starts))
    share = w / (root[i] * root[j])
    drop = lambda rows: np.stack([v - np.add.reduceat(v[j] * share, starts) for v in rows])
    held = vectors * root
    for _ in range(plain):
        held = held - drop(held) / 2
    rest = way = drop(held)
    size = (rest * rest).sum(1)
    for _ in range(combined):
        step = drop(way)
        bend = (way * step).sum(1)
        pace = np.divide(size, bend, out=np.zeros_like(size), where=bend > 0)[:, None]
        held, rest = held + -pace * way, rest - pace * step
        before, size = size, (rest * rest).sum(1)
        way = rest + way * np.divide(size, before, out=np.zeros_like(size), where=before > 0)[:, None]
        if size.max(initial=0.0) < 1e-28:
            break
    return held / root


def kmeans(values: np.ndarray, apart: float = APART) -> np.ndarray:
    """Cluster number of each point (a column of values). The first clusters are what gaps wider than apart leave of each row of values in turn; then each point goes to the nearest centre until none moves."""
    n = values.shape[1]
    label = np.zeros(n, np.int64)
    for row in values:
        order = np.lexsort((row, label))
        new = (np.diff(label[order]) != 0) | (np.diff(row[order]) > apart)
        label[order] = np.cumsum(np.r_[0, new])
    for _ in range(100):
        label = np.unique(label, return_inverse=True)[1]
        k = int(label.max()) + 1
        size = np.bincount(label, minlength=k)
        centre = np.stack([np.bincount(label, row, k) / size for row in values])
        # the centres that lie next to a point in the first row, and its own
        order = np.argsort(centre[0], kind="stable")
        at = np.searchsorted(centre[0, order], values[0])
        near = np.stack([label, *(order[np.clip(at + step, 0, k - 1)] for step in (-2, -1, 0, 1))])
        far = ((values[:, None, :] - centre[:, near]) ** 2).sum(0)
        moved = near[np.argmin(far, axis=0), np.arange(n)]
        if (moved == label).all():
            break
        label = moved
    return label


def spectral_clusters(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, ids: np.ndarray, combined: int = FIRST_STEPS) -> np.ndarray:
    """Cluster number of each of n points: k-means over the converged vectors. A point without links is a cluster of its own.

    A cluster is done when its vectors have converged over all of its links and no link leaves it. The others go on
    with twice as many steps; without progress in twice the steps that any graph of their size needs it is an error.
    """
    out = np.arange(n)
    points = np.unique(np.concatenate([a, b]))
    number = np.full(n, -1)
    number[points] = np.arange(len(points))
    i, j, w = _both_ways(len(points), number[a], number[b], w)
    vectors = start_vectors(ids[points])
    done = n
    while len(points):
        vectors = iterate(i, j, w, vectors, combined)
        label = kmeans(vectors)
        off = (label[i] != label[j]) | (np.abs(vectors[:, i] - vectors[:, j]).max(0) > TOLERANCE)
        open_ = np.zeros(int(label.max()) + 1, bool)
        open_[label[i[off]]] = True
        open_[label[j[off]]] = True
        left = open_[label]
        out[points[~left]] = done + label[~left]
        done += len(open_)
        if left.all() and combined > 20 * len(points) + 1000:
            raise RuntimeError("the vectors have not converged")
        kept, number = left[i], np.cumsum(left) - 1
        i, j, w = number[i[kept]], number[j[kept]], w[kept]
        points, vectors = points[left], vectors[:, left]
        combined *= 2
    return np.unique(out, return_inverse=True)[1]


def _name(label: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each point's cluster."""
    smallest = np.full(int(label.max()) + 1 if len(label) else 0, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return smallest[label]


def cluster(points: DataFrame, key: str, columns: list[str], radius2: float, least: int = 1, leaf_rows: int = kdsplit.LEAF_ROWS) -> DataFrame:
    """(cluster_id, id, affinity, size): the points of all clusters of at least `least` points.

    cluster_id is the smallest key of the cluster, affinity the sum of a point's affinities, all of them to members of
    its cluster, and size the number of members. A point without all coordinates takes no part. A key delivered again
    with the same values counts once. A point without links is a cluster of one. Points at one place are linked; of a
    hot place (see kdsplit) the smallest key alone is clustered and stands for the others, with their number as its
    weight, so that affinities are the same as without it. No points give no rows. Other columns take no part.
    """
    names = [f"v{i}" for i in range(len(columns))]
    places = points.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    places = places.where(F.col("id").isNotNull() & kdsplit.present(*[F.col(n) for n in names]))
    rows, sample = kdsplit.bounded_sample(places, "id", names)
    splits = kdsplit.fit_splits(sample, rows, leaf_rows, places, "id", names)
    places, members = kdsplit.split_hot(places, "id", names, kdsplit.hot_positions(sample))
    if members is None:
        places = places.withColumn("copies", F.lit(1.0))
    else:
        counts = members.groupBy(F.col("_rep").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("copies"))
        places = places.join(F.broadcast(counts), "id", "left").select("id", *names, F.coalesce("copies", F.lit(1.0)).alias("copies"))
    routed = kdsplit.route(places, "id", [*names, "copies"], splits, float(np.sqrt(radius2)) * (1 + 1e-12), to_space=lambda v: v[:, : len(columns)])
    single = members is None  # then small clusters inside a leaf are known to be small

    def in_leaf(held: pa.Table) -> pa.Table:
        ids, first = np.unique(held.column("id").to_numpy(), return_index=True)
        own = held.column("own").to_numpy()[first]
        at = np.column_stack([held.column(n).to_numpy()[first] for n in names])
        # points at one place are one node of the graph, with their number as its weight
        stands_for = held.column("copies").to_numpy()[first]
        place, first, at_place = np.unique(at, axis=0, return_index=True, return_inverse=True)
        at_place = at_place.reshape(-1)
        copies = np.bincount(at_place, stands_for, len(place))
        i, j = kdsplit.pairs_within(place, radius2)
        step = place[i] - place[j]
        w = np.exp(-2 * (step * step).sum(1) / radius2)
        m = len(place)
        near = np.bincount(i, w * copies[j], m) + np.bincount(j, w * copies[i], m) + copies - 1
        affinity = near[at_place]
        place_ids, own_place = ids[first], own[first]  # first is the smallest id of its place, for ids are sorted; copies of a place are all in one leaf
        inner = own_place[i] & own_place[j]
        of_place = spectral_clusters(m, i[inner], j[inner], w[inner], place_ids)
        label = of_place[at_place]
        name = _name(label, ids)
        size = np.bincount(label)[label]
        # links over the edge, seen from this leaf's side
        out, into = np.where(own_place[i], i, j), np.where(own_place[i], j, i)
        over = own_place[i] != own_place[j]
        out, into, w = out[over], into[over], w[over]
        crossing = np.zeros(int(label.max()) + 1, bool)
        crossing[of_place[out]] = True
        kept = np.nonzero(own & ((size >= least) | crossing[label] | (not single)))[0]
        border = np.zeros(len(ids), bool)
        border[first[out]] = True
        leaf = held.column("leaf")[0].as_py()
        k, m = len(kept), len(out)
        pad = np.arange(k + m) >= k
        return pa.table({
            "id": np.concatenate([ids[kept], place_ids[into]]), "name": np.concatenate([name[kept], name[first[out]]]), "leaf": np.full(k + m, leaf),
            "affinity": np.concatenate([affinity[kept], w]), "link": pad, "border": np.concatenate([border[kept], np.zeros(m, bool)]),
        })

    solved = cut(routed.groupBy("leaf").applyInArrow(in_leaf, "id long, name long, leaf long, affinity double, link boolean, border boolean"))
    labels = solved.where(~F.col("link")).select("id", "name", "affinity")
    # cluster to cluster, each pair once from either side
    ends = solved.where(F.col("border")).select("id", F.col("name").alias("other"), F.col("leaf").alias("other_leaf"))
    links = solved.where("link").select("id", "name", "leaf", "affinity").join(ends, "id").groupBy("name", "leaf", "other", "other_leaf").agg(F.sum("affinity").alias("w")).where("leaf < other_leaf").select("name", "leaf", "other", "other_leaf", "w")
    final = _join_levels(cut(links) if splits.depth else links, splits.depth)
    labels = labels.join(final, labels["name"] == final["_from"], "left").select("id", F.coalesce("_to", "name").alias("cluster_id"), "affinity")
    if members is not None:
        hot = labels.join(F.broadcast(members.select(F.col("_rep").alias("id")).distinct()), "id", "left_semi").withColumnRenamed("id", "_rep")
        labels = labels.unionByName(members.where("id <> _rep").join(F.broadcast(hot), "_rep").select("id", "cluster_id", "affinity"))
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "cluster_id").select("cluster_id", "id", "affinity", "size")


def _join_levels(links: DataFrame, depth: int) -> DataFrame:
    """(_from, _to): the new name of each cluster that a link over an edge joins to another, level by level up the splits."""
    spark = links.sparkSession
    empty = spark.createDataFrame([], "_from long, _to long")
    if not depth:
        return empty
    moved = empty
    level = 0
    while level < depth:
        level = min(depth, level + LEVELS)
        shift = level

        def in_block(held: pa.Table) -> pa.Table:
            name, other = held.column("name").to_numpy(), held.column("other").to_numpy()
            ids, at = np.unique(np.concatenate([name, other]), return_inverse=True)
            m = len(name)
            label = spectral_clusters(len(ids), at[:m], at[m:], held.column("w").to_numpy(), ids)
            return pa.table({"_from": ids, "_to": _name(label, ids)})

        block = F.shiftright("leaf", shift)
        here = links.where(block == F.shiftright("other_leaf", shift))
        step = cut(here.groupBy(block.alias("block")).applyInArrow(in_block, "_from long, _to long"))
        moved = _rename(moved, "_to", step).unionByName(step)
        if level < depth:
            rest = links.where(block != F.shiftright("other_leaf", shift))
            links = cut(_rename(_rename(rest, "name", step), "other", step))
        moved = cut(moved)
    return moved.where("_from <> _to").groupBy("_from").agg(F.min("_to").alias("_to"))


def _rename(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    new = step.select(F.col("_from").alias("_f"), F.col("_to").alias("_t"))
    return rows.join(new, rows[column] == new["_f"], "left").withColumn(column, F.coalesce("_t", column)).drop("_f", "_t")


def describe(clusters: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_id, size, typical): each cluster with its most typical members, those of the most affinity, ties by id."""
    best = Window.partitionBy("cluster_id").orderBy(F.desc("affinity"), "id")
    ranked = clusters.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= typical)  # limited before the shuffle too
    return ranked.groupBy("cluster_id").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("_rank", "id"))).alias("_typical")).select("cluster_id", "size", F.col("_typical.id").alias("typical"))
