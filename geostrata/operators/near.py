"""Points near other points, and the regions that contain them.

Plane coordinates are laid on a sphere around the middle of the data, as longitude x / R and latitude y / R, and turned
into three-dimensional unit vectors. This map never lengthens a distance, so a chord of radius / R finds every pair
that is within the radius in the plane; the plane distance of what is found is then tested exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wkt import bounds, parse_polygons, sweep_inside
from ..session import cut
from . import kdsplit

EARTH_RADIUS = 6_371_008.8
#: Rounding of unit vectors, as a chord.
_SLACK = 4e-15
#: Members of a hot place that are expanded at a time.
HOT_BLOCK = 1000


@dataclass(frozen=True)
class Sphere:
    """Frame that takes plane x and y to unit vectors."""

    x0: float
    y0: float
    radius: float = EARTH_RADIUS

    def unit(self, points: np.ndarray) -> np.ndarray:
        lon, lat = (points[:, 0] - self.x0) / self.radius, (points[:, 1] - self.y0) / self.radius
        return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    def chord(self, distance: float) -> float:
        return distance / self.radius * (1 + 1e-9) + _SLACK


def _regions_to_leaves(zones: DataFrame, zone_id: str, wkt: str, splits: kdsplit.KdSplits, frame: Sphere) -> DataFrame:
    def send(batches):
        for batch in batches:
            ids, texts, leaves = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                box = bounds(parse_polygons(text))
                if box is None or key is None:
                    continue
                middle = np.array([[(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]])
                half = frame.chord(float(np.hypot(box[2] - box[0], box[3] - box[1])) / 2)
                at = frame.unit(middle)
                found = splits.touching(at - half, at + half)[1]
                ids += [key] * len(found)
                texts += [text] * len(found)
                leaves += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["leaf", "zone", "wkt"])

    return zones.select(F.col(zone_id).cast("long"), F.col(wkt).cast("string")).mapInArrow(send, "leaf long, zone long, wkt string")


def near(points: DataFrame, key: str, x: str, y: str, radius2: float, zones: DataFrame | None = None, zone_id: str = "zone_id", wkt: str = "wkt", leaf_rows: int = kdsplit.LEAF_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (kind, id_a, id_b): 'point' for two points within the radius, smaller key first, 'zone' for a zone and a point in it.

    A point without both coordinates has no place and takes no part. A key delivered again with the same place counts
    once. Points at one place are pairs of each other (at distance 0); a hot place, one that holds so many rows that
    it shows HOT_ROWS times in the sample, goes through as its smallest key alone and its members come as the second
    result, (key, _rep), else None: expand() gives the pairs of all members. Null, empty and unreadable shapes hold no
    point; a zone with several rows is all their shapes together. Empty inputs give no pair. Other columns of the inputs take no part.
    """
    places = points.select(F.col(key).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("id").isNotNull() & kdsplit.present(F.col("x"), F.col("y")))
    rows, sample = kdsplit.bounded_sample(places, "id", ["x", "y"])
    middle = np.median(sample, axis=0) if len(sample) else np.zeros(2)
    frame = Sphere(float(middle[0]), float(middle[1]))
    splits = kdsplit.fit_splits(frame.unit(sample), rows, leaf_rows, places, "id", ["x", "y"], frame.unit)
    places, members = kdsplit.split_hot(places, "id", ["x", "y"], kdsplit.hot_positions(sample))
    routed = kdsplit.route(places, "id", ["x", "y"], splits, frame.chord(float(np.sqrt(radius2))), frame.unit)
    if zones is None:
        zones = points.sparkSession.createDataFrame([], f"{zone_id} long, {wkt} string")
    shapes = _regions_to_leaves(zones, zone_id, wkt, splits, frame)

    def join_leaf(held: pa.Table, regions: pa.Table) -> pa.Table:
        ids, first = np.unique(held.column("id").to_numpy(), return_index=True)
        own = held.column("own").to_numpy()[first]
        at = np.column_stack([held.column(c).to_numpy()[first] for c in ("x", "y")]) if len(ids) else np.zeros((0, 2))
        a, b = pairs_of(at, ids, own)
        kinds, left, right = [pa.array(["point"]).take(pa.array(np.zeros(len(a), np.int64)))], [a], [b]
        mine = np.nonzero(own)[0]
        mine = mine[np.argsort(at[mine, 0], kind="stable")]
        xs, ys = at[mine, 0], at[mine, 1]
        shapes_of: dict[int, dict[str, None]] = {}
        for zone, text in zip(regions.column("zone").to_pylist(), regions.column("wkt").to_pylist(), strict=True):
            shapes_of.setdefault(zone, {})[text] = None
        for zone, texts in shapes_of.items():
            polygons = [polygon for text in texts for polygon in parse_polygons(text)]
            low_x, low_y, high_x, high_y = bounds(polygons)
            begin, end = np.searchsorted(xs, low_x, "left"), np.searchsorted(xs, high_x, "right")
            pick = begin + np.nonzero((ys[begin:end] >= low_y) & (ys[begin:end] <= high_y))[0]
            pick = pick[sweep_inside(polygons, xs[pick], ys[pick])]
            left.append(np.full(len(pick), zone))
            right.append(ids[mine[pick]])
            kinds.append(pa.array(["zone"]).take(pa.array(np.zeros(len(pick), np.int64))))
        return pa.table({"kind": pa.concat_arrays(kinds), "id_a": np.concatenate(left), "id_b": np.concatenate(right)})

    def pairs_of(at: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = frame.unit(at)
        i, j = kdsplit.pairs_within(space, frame.chord(float(np.sqrt(radius2))) ** 2)
        step = at[i] - at[j]
        i, j = i[hit := (step * step).sum(1) <= radius2], j[hit]
        i, j = np.minimum(i, j), np.maximum(i, j)  # ids are sorted
        kept = own[i]  # the leaf of the smaller key gives the pair
        return ids[i[kept]], ids[j[kept]]

    pairs = routed.groupBy("leaf").cogroup(shapes.groupBy("leaf")).applyInArrow(join_leaf, "kind string, id_a long, id_b long")
    return pairs, members


def expand(pairs: DataFrame, members: DataFrame | None) -> DataFrame:
    """Pairs with every member of a hot place in the stead of its smallest key, and the pairs inside the place.

    The members of a place are split by a hash of their keys into blocks of about HOT_BLOCK. What is joined, and spread over
    the tasks, is blocks with blocks; only then they become pairs. So a row stands for about
    HOT_BLOCK * HOT_BLOCK pairs, however many rows are at a place.
    """
    if members is None:
        return pairs
    pairs = cut(pairs)
    sizes = members.groupBy("_rep").agg(F.ceil(F.count(F.lit(1)) / HOT_BLOCK).cast("int").alias("_n"))
    salted = members.join(F.broadcast(sizes), "_rep").withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    blocks = salted.groupBy("_rep", "_salt").agg(F.collect_list("id").alias("_ids"))
    reps = F.broadcast(sizes.select("_rep"))
    point = F.col("kind") == "point"
    hot = pairs.join(reps.withColumnsRenamed({"_rep": "_ra"}), point & (F.col("id_a") == F.col("_ra")), "left").join(reps.withColumnsRenamed({"_rep": "_rb"}), F.col("id_b") == F.col("_rb"), "left")
    plain = hot.where("_ra is null and _rb is null").select("kind", "id_a", "id_b")
    named = lambda side: blocks.select(F.col("_rep").alias(f"_r{side}"), F.col("_salt").alias(f"_s{side}"), F.col("_ids").alias(f"_i{side}"))
    met = hot.where("_ra is not null or _rb is not null").join(named("a"), "_ra", "left").join(named("b"), "_rb", "left")
    outer = met.select("kind", F.coalesce("_ia", F.array("id_a")).alias("_ia"), F.coalesce("_ib", F.array("id_b")).alias("_ib"), F.lit(False).alias("_same"))
    inner = named("a").join(named("b"), (F.col("_ra") == F.col("_rb")) & (F.col("_sa") <= F.col("_sb"))).select(F.lit("point").alias("kind"), "_ia", "_ib", (F.col("_sa") == F.col("_sb")).alias("_same"))
    spread = outer.unionByName(inner).repartition(F.xxhash64(F.col("_ia")[0], F.col("_ib")[0]))
    each = spread.select("kind", "_ib", "_same", F.explode("_ia").alias("id_a")).select("kind", "_same", "id_a", F.explode("_ib").alias("id_b")).where("not _same or id_a < id_b")
    swap = point & (F.col("id_a") > F.col("id_b"))
    return plain.unionByName(each.select("kind", F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b")))
