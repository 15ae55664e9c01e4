"""Lookups of points in rasters, nearest neighbours, as-of lookups and overlays, as joins on computed keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wkt import bounds as wkt_bounds
from ..functions.wkt import parse_polygons, sweep_inside
from ..model import Box, GridSpec
from . import kdsplit


def lookup(points: DataFrame, raster: DataFrame, spec: GridSpec, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Points with the value of the cell that holds them. Points outside the raster or on nodata are dropped."""
    keyed = points.withColumns({"_col": spec.col(F.col("x")), "_row": spec.row(F.col("y"))})
    cells = raster.where(F.col(value).isNotNull()).select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("cell_value"))
    on = (F.col("_row") == F.col("_r")) & (F.col("_col") == F.col("_c"))
    for b in by:
        on = on & (F.col(b) == F.col(f"_by_{b}"))
    return keyed.join(cells, on).drop("_col", "_row", "_r", "_c", *[f"_by_{b}" for b in by])


def bilinear(points: DataFrame, key: str, raster: DataFrame, spec: GridSpec, value: str = "value") -> DataFrame:
    """(key, x, y, sampled): value between the four cell middles around each point; null if one of them is missing.

    Each point is sent to its four cells and meets them in one equality join; the parts are added up again by key.
    """
    u, v = (F.col("x") - spec.tlx) / spec.res_x - 0.5, (F.col("y") - spec.tly) / spec.res_y - 0.5
    held = points.select(key, "x", "y", F.floor(u).cast("int").alias("_c0"), F.floor(v).cast("int").alias("_r0"), (u - F.floor(u)).alias("_fu"), (v - F.floor(v)).alias("_fv"))
    corners = held.withColumn("_corner", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    weight = F.when(F.col("_corner.i") == 1, F.col("_fu")).otherwise(1 - F.col("_fu")) * F.when(F.col("_corner.j") == 1, F.col("_fv")).otherwise(1 - F.col("_fv"))
    keyed = corners.select(key, "x", "y", (F.col("_c0") + F.col("_corner.i")).alias("col"), (F.col("_r0") + F.col("_corner.j")).alias("row"), weight.alias("_w"))
    met = keyed.join(raster.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("_v")), ["row", "col"], "left")
    return met.groupBy(key, "x", "y").agg(F.when(F.count("_v") == 4, F.sum(F.col("_w") * F.col("_v"))).alias("sampled"))


def overlay(a: DataFrame, b: DataFrame, factor: float, value: str = "value") -> DataFrame:
    """(band, row, col, value): a + factor * b by cell; where one has nodata the other's part stands, where both have it null."""
    left, right = a.select("band", "row", "col", F.col(value).alias("_a")), b.select("band", "row", "col", F.col(value).alias("_b"))
    both = F.col("_a") + factor * F.col("_b")
    return left.join(right, ["band", "row", "col"], "full").select("band", "row", "col", F.coalesce(both, F.col("_a"), factor * F.col("_b")).alias("value"))


def box_search(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (box_id, minx, miny, maxx, maxy) and the points in them, half-open. Both are keyed by tiles of a size."""
    span = lambda low, high: F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))
    tiled = boxes.withColumn("_tx", span(F.col("minx"), F.col("maxx"))).withColumn("_ty", span(F.col("miny"), F.col("maxy")))
    keyed = points.withColumns({"_tx": F.floor(F.col("x") / size).cast("long"), "_ty": F.floor(F.col("y") / size).cast("long")})
    inside = (F.col("x") >= F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") >= F.col("miny")) & (F.col("y") < F.col("maxy"))
    return keyed.join(tiled, ["_tx", "_ty"]).where(inside).drop("_tx", "_ty")


def boxes_of(zones: DataFrame, key: str, wkt: str) -> DataFrame:
    """(box_id, minx, miny, maxx, maxy) of polygons in WKT; of a null, empty or unreadable one there is none, and a key's shapes have one box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(k, wkt_bounds(parse_polygons(w))) for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if k is not None]
            held = [(k, b) for k, b in held if b is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), *[pa.array([b[i] for _, b in held], pa.float64()) for i in range(4)]], names=["box_id", "minx", "miny", "maxx", "maxy"])

    found = zones.select(F.col(key).cast("long"), F.col(wkt).cast("string")).mapInArrow(run, "box_id long, minx double, miny double, maxx double, maxy double")
    return found.groupBy("box_id").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def polygon_search(points: DataFrame, key: str, wkt: str) -> DataFrame:
    """Points inside one polygon or multipolygon: those in its box, by columns, and of them the truly inside, by a sweep."""
    shape = parse_polygons(wkt)
    box = wkt_bounds(shape)
    if box is None:
        return points.select(key).limit(0)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            order = np.argsort(x, kind="stable")
            hit = order[sweep_inside(shape, x[order], y[order])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit))], names=[key])

    held = points.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    return held.select(F.col(key).cast("long").alias(key), "x", "y").mapInArrow(inside, f"{key} long")


def tile_files(tiles: DataFrame, files: DataFrame, buffer: float, size: float) -> DataFrame:
    """Tiles (tile_id, minx ... maxy) with the files (file_id, min_x ... max_y) whose boxes meet the buffered tile; touching boxes do not meet."""
    span = lambda low, high: F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))
    t = tiles.withColumn("_tx", span(F.col("minx") - buffer, F.col("maxx") + buffer)).withColumn("_ty", span(F.col("miny") - buffer, F.col("maxy") + buffer))
    f = files.where("min_x is not null and min_y is not null and max_x is not null and max_y is not null and not isnan(min_x)").withColumn("_tx", span(F.col("min_x"), F.col("max_x"))).withColumn("_ty", span(F.col("min_y"), F.col("max_y")))
    meet = (F.col("min_x") < F.col("maxx") + buffer) & (F.col("max_x") > F.col("minx") - buffer) & (F.col("min_y") < F.col("maxy") + buffer) & (F.col("max_y") > F.col("miny") - buffer)
    return t.join(f, ["_tx", "_ty"]).where(meet).select("tile_id", "file_id").distinct()


def _ragged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, row) of the rows of each range [begin, end)."""
    sizes = end - begin
    which = np.repeat(np.arange(len(begin)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - begin, sizes)


def _search_block(tree: tuple, ids: np.ndarray, targets: np.ndarray, k: int | None, radius2: float, visits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, row, d2): the k nearest rows of each target within radius2, all targets at once.

    The boxes nearest to a target hold k rows; the k-th of them bounds the distance, and all boxes within the bound are
    looked at. With visits only so many of the nearest boxes are that hold about that many rows.
    """
    points, low, high, bound = tree
    sizes = np.diff(bound)
    boxes = len(sizes)
    gap2 = np.zeros((len(targets), boxes))
    for axis in range(points.shape[1]):
        gap = np.maximum(0, np.maximum(low[None, :, axis] - targets[:, None, axis], targets[:, None, axis] - high[None, :, axis]))
        gap2 += gap * gap
    most = np.full(len(targets), radius2)
    few = boxes if k is None else min(boxes, 2 + 2 * k // max(1, int(sizes.min())))
    seen = boxes if visits is None else min(boxes, max(1, -(-visits // max(1, int(sizes.max())))))

    def distances(target: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which, row = _ragged(bound[box], bound[box + 1])
        step = points[row] - targets[target[which]]
        return target[which], row, (step * step).sum(1)

    if k is not None and few < boxes:
        nearest = np.argpartition(gap2, few - 1, axis=1)[:, :few]
        target, row, d2 = distances(np.repeat(np.arange(len(targets)), few), nearest.reshape(-1))
        order = np.lexsort((d2, target))
        first = np.searchsorted(target[order], np.arange(len(targets)))
        count = np.diff(np.r_[first, len(target)])
        there = count >= k
        most[there] = np.minimum(most[there], d2[order][first[there] + k - 1])
    open_ = gap2 <= most[:, None]
    if seen < boxes:
        open_ &= np.argsort(np.argsort(gap2, axis=1, kind="stable"), axis=1) < seen
    target, row, d2 = distances(*np.nonzero(open_))
    near = d2 <= most[target]
    target, row, d2 = target[near], row[near], d2[near]
    order = np.lexsort((ids[row], d2, target))
    target, row, d2 = target[order], row[order], d2[order]
    if k is not None:
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        target, row, d2 = target[rank < k], row[rank < k], d2[rank < k]
    return target, row, d2


def knn(queries: DataFrame, query_key: str, points: DataFrame, key: str, columns: list[str], k: int | None, radius: float | None = None, leaf_rows: int = kdsplit.LEAF_ROWS, visits: int | None = None) -> DataFrame:
    """(query_id, id, d2, rank): the k nearest points of each query by squared distance, ties by id, within a closed radius if there is one.

    k of None gives all within the radius. k beyond the number of points gives all of them. A query that is a point
    itself matches itself. Queries and points that lack a coordinate take no part. The result is exact, so it satisfies
    any allowed error; the standard, the priority and the fixed-radius search are this search with k, radius or both.

    Points are cut into leaves by k-d splits; a query goes to the leaves that the distance of its k-th neighbour in the
    sample (an upper bound), or the radius, reaches. Of the points at a hot place (see kdsplit) only the k smallest keys
    can be neighbours, and only they are searched; without k one of them is, and its members come in by a join. With
    visits a query looks at about so many points of a leaf at most, from the nearest boxes on; the result is then approximate.
    """
    if k is None and radius is None:
        raise ValueError("k or a radius")
    names = [f"v{i}" for i in range(len(columns))]

    def places(df: DataFrame, id_: str) -> DataFrame:
        held = df.select(F.col(id_).cast("long").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
        return held.where(F.col("id").isNotNull() & kdsplit.present(*[F.col(n) for n in names]))

    held, asked = places(points, key), places(queries, query_key)
    rows, sample = kdsplit.bounded_sample(held, "id", names)
    splits = kdsplit.fit_splits(sample, rows, leaf_rows, held, "id", names)
    held, members = kdsplit.split_hot(held, "id", names, kdsplit.hot_positions(sample))
    if members is not None and k is not None:
        few = members.withColumn("_n", F.row_number().over(Window.partitionBy("_rep").orderBy("id"))).where(F.col("_n") <= k).where("id <> _rep")
        at = held.join(F.broadcast(few.select("_rep", F.col("id").alias("_id"))), F.col("id") == F.col("_rep"))
        held = held.unionByName(at.select(F.col("_id").alias("id"), *names))
    bound = None if k is None else kdsplit.SampleReach(sample, splits, k)
    fixed = math.inf if radius is None else radius

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            reach = np.full(len(at), fixed) if bound is None else np.minimum(fixed, np.sqrt(bound(at)) * (1 + 1e-9) + 1e-9)
            row, to = splits.touching(at - reach[:, None], at + reach[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(0).take(pa.array(row))] + [pa.array(np.ascontiguousarray(at[row, i])) for i in range(len(names))], names=["leaf", "id", *names])

    schema = ", ".join(f"{n} double" for n in names)

    def in_leaf(entries: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(entries) and len(asks):
            ids, first = np.unique(entries.column("id").to_numpy(), return_index=True)
            at = np.column_stack([entries.column(n).to_numpy()[first] for n in names])
            o, boxes, bounds_ = kdsplit.build_tree(at, 16)
            tree, ids = (at[o], *boxes[-1], bounds_), ids[o]
            query_ids, first = np.unique(asks.column("id").to_numpy(), return_index=True)
            targets = np.column_stack([asks.column(n).to_numpy()[first] for n in names])
            for begin in range(0, len(targets), 200):
                target, row, d2 = _search_block(tree, ids, targets[begin : begin + 200], k, fixed * fixed, visits)
                out.append((query_ids[begin + target], ids[row], d2))
        join = lambda i, kind: np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind)
        return pa.table({"query_id": join(0, np.int64), "id": join(1, np.int64), "d2": join(2, float)})

    routed = kdsplit.route(held, "id", names, splits, 0.0).where("own")
    sent = asked.mapInArrow(send, f"leaf long, id long, {schema}")
    found = routed.groupBy("leaf").cogroup(sent.groupBy("leaf")).applyInArrow(in_leaf, "query_id long, id long, d2 double")
    if members is not None and k is None:
        found = found.join(F.broadcast(members.select("_rep").distinct()), F.col("id") == F.col("_rep"), "left")
        others = found.where("_rep is not null").drop("id").join(members, "_rep").where("id <> _rep")
        found = found.select("query_id", "id", "d2").unionByName(others.select("query_id", "id", "d2"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def search_quality(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, error, recall) of approximate neighbours (query_id, id, d2) against exact ones (query_id, id, d2, rank).

    error is the mean over ranks of distance / exact distance - 1, 0 where the exact distance is 0; recall the share of
    the found that are among the exact. Queries and ranks that one side lacks don't count.
    """
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id")))
    distance = exact.select("query_id", "rank", F.sqrt("d2").alias("_exact"))
    hit = exact.select("query_id", "id", F.lit(1.0).alias("_hit"))
    met = ranked.join(distance, ["query_id", "rank"]).join(hit, ["query_id", "id"], "left")
    off = F.when(F.col("_exact") > 0, F.sqrt("d2") / F.col("_exact") - 1).otherwise(0.0)
    return met.groupBy("query_id").agg(F.avg(off).alias("error"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))


def range_count(queries: DataFrame, query_key: str, points: DataFrame, key: str, columns: list[str], radius: float) -> DataFrame:
    """(query_id, n): the number of points within the closed radius, 0 included."""
    found = knn(queries, query_key, points, key, columns, None, radius).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select(F.col(query_key).cast("long").alias("query_id")).join(found, "query_id", "left").fillna({"n": 0})


#: Vectors of the sample that the axes of an embedding search are fitted to, and the number of axes.
AXES_ROWS, AXES = 20_000, 8


def embedding_knn(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, dims: int, error: float = 0.0, leaf_rows: int = kdsplit.LEAF_ROWS) -> DataFrame:
    """(query_id, id, d2, rank): the k nearest vectors of each query, ties by id; vectors are array columns of dims numbers.

    Vectors are laid on the AXES main axes of a bounded sample. That never lengthens a distance, so leaves of k-d splits
    there are left out safely: a query goes to the leaves that the distance of its k-th neighbour in the sample reaches,
    divided by 1 + error. With an error of 0 the result is exact; with more, a neighbour that is left out is at most so
    much nearer than one in its place. In a leaf the queries meet all vectors as a product of matrices, by blocks. A null
    vector, one of another length, or with a number that is null or not finite takes no part.
    """
    some = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held, asked = some(points).where(sound), some(queries).where(sound)
    rows = held.count()
    chosen = held if rows <= AXES_ROWS else held.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int((1 << 30) * AXES_ROWS / rows))

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dims)

    got = chosen.toArrow()
    sample = matrix(got.column("v"))[np.unique(got.column("id").to_numpy(), return_index=True)[1]]
    middle = sample.mean(0) if len(sample) else np.zeros(dims)
    axes = np.linalg.eigh((sample - middle).T @ (sample - middle))[1][:, ::-1][:, : min(AXES, dims)] if len(sample) else np.eye(dims)[:, : min(AXES, dims)]
    to_axes = lambda v: (v - middle) @ axes
    splits = kdsplit.fit_splits(to_axes(sample), rows, leaf_rows)
    bound = kdsplit.SampleReach(to_axes(sample), splits, k, sample)

    def send(batches: Iterator[pa.RecordBatch], far: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1))
            at = to_axes(v)
            if far:
                reach = np.sqrt(bound(at, v)) / (1 + error) * (1 + 1e-9) + 1e-9
                row, to = splits.touching(at - reach[:, None], at + reach[:, None])
            else:
                row, to = np.arange(len(at)), splits.locate(at)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(0).take(row), batch.column(1).take(row)], names=["leaf", "id", "v"])

    def in_leaf(entries: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(entries) and len(asks):
            ids, first = np.unique(entries.column("id").to_numpy(), return_index=True)
            at = matrix(entries.column("v"))[first]
            query_ids, first = np.unique(asks.column("id").to_numpy(), return_index=True)
            targets = matrix(asks.column("v"))[first]
            size = (at * at).sum(1)
            for begin in range(0, len(targets), 64):
                t = targets[begin : begin + 64]
                rough = size[None, :] - 2 * t @ at.T + (t * t).sum(1)[:, None]
                most = np.partition(rough, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
                # the product is rounded: what may be among the nearest is measured again
                target, row = np.nonzero(rough <= (most + 1e-9 * (1 + size.max() + (t * t).sum(1)))[:, None])
                step = at[row] - t[target]
                d2 = (step * step).sum(1)
                order = np.lexsort((ids[row], d2, target))
                target, row, d2 = target[order], row[order], d2[order]
                kept = np.arange(len(target)) - np.searchsorted(target, target) < k
                out.append((query_ids[begin + target[kept]], ids[row[kept]], d2[kept]))
        join = lambda i, kind: np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind)
        return pa.table({"query_id": join(0, np.int64), "id": join(1, np.int64), "d2": join(2, float)})

    schema = "leaf long, id long, v array<double>"
    routed, sent = held.mapInArrow(lambda b: send(b, False), schema), asked.mapInArrow(lambda b: send(b, True), schema)
    found = routed.groupBy("leaf").cogroup(sent.groupBy("leaf")).applyInArrow(in_leaf, "query_id long, id long, d2 double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id"))).where(F.col("rank") <= k)


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], forward: bool = False, chunk: float | None = None) -> DataFrame:
    """left with the values (as <name>_as_of) of the latest right row at or before its time, or forward, of the earliest at or after it, by group.

    time is a number. Rows of both sides are ordered together and the last right value is carried on: one shuffle, no
    range join. Where right has several rows of one time the greatest values, taken as a whole, count. No match, or a
    null time or group, gives nulls. With chunk, a width of time, a group is cut into chunks that are ordered apart, each
    beginning with what the chunks before it leave; so a group of any size is spread over tasks.
    """
    marked = F.struct(*[F.col(v) for v in values])
    sign = -1.0 if forward else 1.0
    at = F.col(time).cast("double") * sign
    kind = right.select(marked.alias("s")).schema["s"].dataType
    piece = F.floor(at / chunk).cast("long") if chunk else F.lit(0).cast("long")
    b = right.where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.max(marked).alias("_right")).withColumns({"_at": at, "_side": F.lit(0), "_piece": piece})
    a = left.withColumns({"_right": F.lit(None).cast(kind), "_at": at, "_side": F.lit(1), "_piece": piece})
    both = a.unionByName(b, allowMissingColumns=True)
    span = Window.partitionBy(*by, "_piece").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_carried", F.last("_right", ignorenulls=True).over(span)).where("_side = 1")
    found = F.col("_carried")
    if chunk:
        last = both.groupBy(*by, "_piece").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_at"))).alias("_last"))
        before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        into = last.select(*[F.col(g).alias(f"_by{i}") for i, g in enumerate(by)], F.col("_piece").alias("_p"), F.last("_last", ignorenulls=True).over(before).alias("_into"))
        on = F.col("_piece").eqNullSafe(F.col("_p"))
        for i, g in enumerate(by):
            on = on & F.col(g).eqNullSafe(F.col(f"_by{i}"))
        carried = carried.join(into, on, "left")
        found = F.coalesce("_carried", "_into")
    matched = F.when(F.col("_at").isNotNull(), found)
    return carried.select(*left.columns, *[matched[v].alias(f"{v}_as_of") for v in values])


def nearest_mean(points: DataFrame, means: list[tuple[float, ...]], columns: list[str]) -> Column:
    """Index of the nearest of k means (a list of bounded size, held by the plan), ties to the first."""
    if len(means) > 1000:
        raise ValueError("more than 1000 means: use knn")
    distances = [sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, m, strict=True)), F.lit(0.0)) for m in means]
    best = F.least(*distances) if len(distances) > 1 else distances[0]
    return F.coalesce(*[F.when(d == best, i) for i, d in enumerate(distances)])


def in_box(box: Box) -> Column:
    return box.contains(F.col("x"), F.col("y"))
