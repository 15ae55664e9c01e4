"""Connected regions of rasters: labels, boxes and areas, void filling, and polygons of their outlines.

A raster is cut into tiles that share a border of one cell. The cells of a tile are labelled as an array; the labels of
neighbouring tiles that hold the same border cell are then joined by large-star and small-star steps over label pairs,
which are as many as border cells and not as cells.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import GridSpec
from ..session import cut

TILE = 512
_COL_BITS = 31


def connect(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) of longs lead to, of each node of an edge.

    Large-star and small-star steps in turns, until nothing changes. A step moves each edge once and adds none, however
    many edges a node has; lineage is cut after each round.
    """
    held = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    held = cut(held.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        met = e.join(least, "a")
        return met.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    before = None
    for _ in range(rounds):
        held = cut(small(large(held)))
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"regions are not joined after {rounds} rounds")


def _label_tile(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, diagonal: bool) -> np.ndarray:
    """Smallest index of the region of each cell: runs are joined to the runs of the row above that they touch."""
    order = np.lexsort((cols, rows))
    r, c, v = rows[order], cols[order], values[order]
    n = len(r)
    new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1) | (v[1:] != v[:-1])]
    run = np.cumsum(new) - 1
    width = int(c.max() - c.min()) + 3
    key = r.astype(np.int64) * width + (c - c.min() + 1)
    parent = np.arange(run[-1] + 1)
    links = [(1, 0), *([(1, -1), (1, 1)] if diagonal else [])]
    a_all, b_all = [], []
    for dr, dc in links:
        at = np.searchsorted(key, key - dr * width + dc)
        at = np.minimum(at, n - 1)
        hit = (key[at] == key - dr * width + dc) & (v[at] == v)
        a_all.append(run[hit])
        b_all.append(run[at[hit]])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        parent = parent[parent]
        while not (parent == parent[parent]).all():
            parent = parent[parent]
        if (parent == before).all():
            break
    start = np.nonzero(new)[0]
    out = np.empty(n, np.int64)
    out[order] = order[start[parent[run]]]
    return out


def components(raster: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(band, row, col, value, region): each cell with the id of its region of equal values, 4-connected or with diagonals.

    region is row << 31 | col of the region's first cell in row order, so it is unique within its band. Rows and columns
    are at least 0 and below 2^31; cells without data have no region.
    """
    held = raster.where(F.col("value").isNotNull()).select("band", "row", "col", F.col("value").cast("double").alias("value"))
    # a tile holds its cells and one more row and column: what two tiles share joins their labels
    span = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - 1) / tile)), F.floor(F.col(c) / tile)))
    spread = held.withColumn("tile_row", span("row")).withColumn("tile_col", span("col"))

    def label(cells: pa.Table) -> pa.Table:
        band, tr, tc = (cells.column(n)[0].as_py() for n in ("band", "tile_row", "tile_col"))
        rows, cols, values = (cells.column(n).to_numpy() for n in ("row", "col", "value"))
        first = _label_tile(rows, cols, values, diagonal)
        code = rows.astype(np.int64) << _COL_BITS | cols
        own = (rows // tile == tr) & (cols // tile == tc)
        edge = (rows % tile == 0) | (cols % tile == 0)
        name = code.copy()
        least = np.full(len(code), np.iinfo(np.int64).max)
        np.minimum.at(least, first, code)
        name = least[first]
        kept = own | edge
        return pa.table({"band": np.full(kept.sum(), band, np.int32), "row": rows[kept], "col": cols[kept], "value": values[kept], "name": name[kept], "tile": np.full(kept.sum(), tr * (1 << 31) + tc), "own": own[kept], "edge": edge[kept]})

    labelled = cut(spread.groupBy("band", "tile_row", "tile_col").applyInArrow(label, "band int, row int, col int, value double, name long, tile long, own boolean, edge boolean"))
    final = _join_tiles(labelled.where("edge").select("band", "row", "col", "tile", "name"))
    own = labelled.where("own")
    return own.join(final, ["band", "tile", "name"], "left").select("band", "row", "col", "value", F.coalesce("region", "name").alias("region"))


def _join_tiles(shared: DataFrame) -> DataFrame:
    """(band, tile, name, region): the region of each region of a tile that has border cells (band, row, col, tile, name). A border cell says which of them are one."""
    keys = ["band", "tile", "name"]
    nodes = cut(shared.select(*keys).distinct().withColumn("node", F.monotonically_increasing_id()))
    at = shared.join(nodes, keys).select("band", "row", "col", "node")
    pairs = at.withColumn("to", F.min("node").over(Window.partitionBy("band", "row", "col"))).where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")).distinct()
    joined = nodes.join(connect(pairs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return joined.withColumn("region", F.min("name").over(Window.partitionBy("root"))).select(*keys, "region")


def boxes(labelled: DataFrame) -> DataFrame:
    """(band, region, value, min_row, max_row, min_col, max_col, area): the box and the cells of each region."""
    return labelled.groupBy("band", "region").agg(F.first("value").alias("value"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count(F.lit(1)).alias("area"))


def flood_fill(raster: DataFrame, row: int, col: int, target: Column, value: float, diagonal: bool = False) -> DataFrame:
    """raster with value in the region of cells that match target and are connected to a seed cell."""
    marked = raster.withColumn("_hit", target)
    regions = components(marked.where("_hit").select("band", "row", "col", F.lit(1.0).alias("value")), diagonal)
    seed = regions.where((F.col("row") == row) & (F.col("col") == col)).select("band", "region")
    filled = regions.join(F.broadcast(seed), ["band", "region"]).select("band", "row", "col", F.lit(float(value)).alias("_new"))
    return raster.join(filled, ["band", "row", "col"], "left").select("band", "row", "col", F.coalesce("_new", "value").alias("value"))


def _void_tiles(data: DataFrame, frame: DataFrame, tile: int, wanted: DataFrame | None = None) -> DataFrame:
    """The cells without data of each tile of each band's frame, labelled where they lie: no void is a row before it must be one.

    Without wanted: (kind, band, tile_row, tile_col, name, row, col, max_row, max_col), for each region of a tile its box
    (kind 0) and its border cells (kind 1). With wanted, (band, tile_row, tile_col, names, regions): the own cells of these.
    """
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / tile).cast("int"), F.floor(F.col(high) / tile).cast("int")))
    tiles = frame.withColumn("tile_row", span("min_row", "max_row")).withColumn("tile_col", span("min_col", "max_col"))
    keys = ["band", "tile_row", "tile_col"]
    if wanted is not None:
        tiles = tiles.join(wanted, keys)
    tiles = tiles.select(*[F.col(c).alias(c) for c in tiles.columns])  # the frame may come from the raster: its columns are told apart
    shared = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - 1) / tile)).cast("int"), F.floor(F.col(c) / tile).cast("int")))
    held = data.select("band", "row", "col").withColumn("tile_row", shared("row")).withColumn("tile_col", shared("col"))
    names = ["kind", *keys, "name", "row", "col", "max_row", "max_col"]
    summary = wanted is None

    def label(cells: pa.Table, one: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if len(one):
            f = {c: one.column(c)[0].as_py() for c in one.column_names}
            r0, r1 = max(f["min_row"], f["tile_row"] * tile), min(f["max_row"], (f["tile_row"] + 1) * tile)
            c0, c1 = max(f["min_col"], f["tile_col"] * tile), min(f["max_col"], (f["tile_col"] + 1) * tile)
            void = np.ones((r1 - r0 + 1, c1 - c0 + 1), bool)
            if len(cells):
                r, c = cells.column("row").to_numpy(), cells.column("col").to_numpy()
                inside = (r >= r0) & (r <= r1) & (c >= c0) & (c <= c1)
                void[r[inside] - r0, c[inside] - c0] = False
            r, c = np.nonzero(void)
            r, c = r + r0, c + c0
            if len(r):
                code = r.astype(np.int64) << _COL_BITS | c
                of, at = np.unique(_label_tile(r, c, np.zeros(len(r)), False), return_inverse=True)
                name = np.full(len(of), np.iinfo(np.int64).max)
                np.minimum.at(name, at, code)
                if summary:
                    low, high = np.full((2, len(of)), np.iinfo(np.int32).max), np.full((2, len(of)), -1)
                    for k, v in enumerate((r, c)):
                        np.minimum.at(low[k], at, v)
                        np.maximum.at(high[k], at, v)
                    edge = (r % tile == 0) | (c % tile == 0)
                    parts = [(0, name, low[0], low[1], high[0], high[1]), (1, name[at[edge]], r[edge], c[edge], r[edge], c[edge])]
                else:
                    region = dict(zip(f["names"], f["regions"], strict=True))
                    to = np.array([region.get(n, -1) for n in name.tolist()], np.int64)[at]
                    own = (to >= 0) & (r // tile == f["tile_row"]) & (c // tile == f["tile_col"])
                    parts = [(2, to[own], r[own], c[own], r[own], c[own])]
        sizes = [len(p[1]) for p in parts]
        n = sum(sizes)
        whole = lambda v: np.full(n, v, np.int32)
        flat = [np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(1, 6)]
        key = [one.column(c)[0].as_py() if len(one) else 0 for c in keys]
        return pa.table(dict(zip(names, [np.repeat([p[0] for p in parts], sizes).astype(np.int32), *(whole(k) for k in key), flat[0], *(v.astype(np.int32) for v in flat[1:])], strict=True)))

    return held.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(label, "kind int, band int, tile_row int, tile_col int, name long, row int, col int, max_row int, max_col int")


#: Side of the squares of cells that a hole and the data around it are cut into to be weighed.
WEIGH = 64


def _weigh(r: np.ndarray, c: np.ndarray, u: np.ndarray, v: np.ndarray, value: np.ndarray, exponent: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights, and of weights times values, at cells (r, c) over cells (u, v): cell by cell, or, of two full squares, as a convolution."""
    kernel = lambda d2: np.where(d2 > 0, np.maximum(d2, 1.0) ** -exponent, 0.0)
    if len(r) * len(u) <= 2_000_000:
        w = kernel((r[:, None] - u[None, :]).astype(float) ** 2 + (c[:, None] - v[None, :]).astype(float) ** 2)
        return w.sum(1), w @ value
    r0, c0, u0, v0 = r.min(), c.min(), u.min(), v.min()
    n = 2 * WEIGH
    step = np.arange(n) - WEIGH + 1
    at = kernel((step + (r0 - u0))[:, None].astype(float) ** 2 + (step + (c0 - v0))[None, :].astype(float) ** 2)
    fields = np.zeros((2, n, n))
    fields[0, u - u0, v - v0], fields[1, u - u0, v - v0] = 1.0, value
    found = np.fft.irfft2(np.fft.rfft2(fields) * np.fft.rfft2(at), s=(n, n))
    return tuple(np.maximum(f, 0.0) if k == 0 else f for k, f in enumerate(found[:, r - r0 + WEIGH - 1, c - c0 + WEIGH - 1]))


def void_fill(raster: DataFrame, extents: DataFrame, exponent: float = 2.0, tile: int = TILE) -> DataFrame:
    """(band, row, col, value): the cells of holes, filled.

    extents gives each band's frame (band, min_row, max_row, min_col, max_col). A hole is a 4-connected region without data
    that does not touch the frame's edge; each of its cells gets the mean of all cells with data in the hole's box grown by
    1, weighted by (1 / squared distance) to the exponent. Voids are found by tile and become rows only where they are
    holes; a hole and the data of its box are weighed by pairs of squares of cells, each pair a row of arrays.
    """
    frame = extents.select("band", "min_row", "max_row", "min_col", "max_col")
    data = raster.where(F.col("value").isNotNull()).select("band", "row", "col", F.col("value").cast("double").alias("value"))
    found = cut(_void_tiles(data, frame, tile))
    number = (F.col("tile_row").cast("long") * (1 << 31) + F.col("tile_col")).alias("tile")
    final = _join_tiles(found.where("kind = 1").select("band", "row", "col", number, "name"))
    parts = found.where("kind = 0").withColumn("tile", number).join(final, ["band", "tile", "name"], "left").withColumn("region", F.coalesce("region", "name"))
    box = parts.groupBy("band", "region").agg(F.min("row").alias("a"), F.max("max_row").alias("b"), F.min("col").alias("c"), F.max("max_col").alias("d"))
    inner = cut(box.join(frame, "band").where("a > min_row and b < max_row and c > min_col and d < max_col").select("band", "region", "a", "b", "c", "d"))
    names = parts.join(inner.select("band", "region"), ["band", "region"]).groupBy("band", "tile_row", "tile_col").agg(F.collect_list("name").alias("names"), F.collect_list("region").alias("regions"))
    holes = _void_tiles(data, frame, tile, names).select("band", F.col("name").alias("region"), "row", "col")
    # the inside of each box meets the data by an equality of cells, not by a range
    near = inner.withColumn("row", F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1))).withColumn("col", F.explode(F.sequence(F.col("c") - 1, F.col("d") + 1))).select("band", "region", "row", "col")
    known = near.join(data, ["band", "row", "col"])
    square = lambda c: F.floor(F.col(c) / WEIGH).cast("int")
    by = ["band", "region", "i", "j"]
    hole_squares = holes.withColumns({"i": square("row"), "j": square("col")}).groupBy(*by).agg(F.collect_list(F.struct("row", "col")).alias("hole"))
    data_squares = known.withColumns({"i": square("row"), "j": square("col")}).groupBy(*by).agg(F.collect_list(F.struct("row", "col", "value")).alias("known"))
    pairs = hole_squares.join(data_squares.withColumnsRenamed({"i": "k", "j": "l"}), ["band", "region"]).select("band", "hole.row", "hole.col", F.col("known.row").alias("u"), F.col("known.col").alias("v"), "known.value")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r, c, u, v, value = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in range(1, 6))
                weight, sums = _weigh(r, c, u, v, value, exponent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), batch.column(0)[k].as_py(), np.int32)), pa.array(r), pa.array(c), pa.array(weight), pa.array(sums)], names=["band", "row", "col", "w", "s"])

    return pairs.mapInArrow(weigh, "band int, row int, col int, w double, s double").groupBy("band", "row", "col").agg((F.sum("s") / F.sum("w")).alias("value"))


def sessions(raster: DataFrame) -> DataFrame:
    """(band, row, col, value, session): cells with the number of the stretch of rows in which their value occurs without a gap.

    A value that is absent from a row begins a new session when it comes back.
    """
    present = raster.where(F.col("value").isNotNull()).select("band", "value", "row").distinct()
    w = Window.partitionBy("band", "value").orderBy("row")
    broken = F.when(F.lag("row").over(w) == F.col("row") - 1, 0).otherwise(1)
    numbered = present.withColumn("_new", broken).withColumn("session", F.sum("_new").over(w).cast("int")).drop("_new")
    return raster.join(numbered, ["band", "value", "row"]).select("band", "row", "col", "value", "session")


def outline(rows: np.ndarray, cols: np.ndarray, up: np.ndarray, right: np.ndarray, down: np.ndarray, left: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings, by corners (col, row), around cells of which the open sides are told; outer rings one way and holes the other.

    Corners that meet diagonally split.
    """
    onward: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for r, c, u, e, d, w in zip(rows.tolist(), cols.tolist(), up, right, down, left, strict=True):
        if u:
            onward[(c, r)].append((c + 1, r))
        if e:
            onward[(c + 1, r)].append((c + 1, r + 1))
        if d:
            onward[(c + 1, r + 1)].append((c, r + 1))
        if w:
            onward[(c, r + 1)].append((c, r))
    rings = []
    for start in sorted(onward):
        while onward[start]:
            ring = [start]
            at, came = onward[start].pop(), start
            while at != start:
                ring.append(at)
                ways = onward[at]
                step = (at[0] - came[0], at[1] - came[1])
                # where two ways lead on, the one that turns right keeps each region's ring its own
                pick = next((w for w in ways if (w[0] - at[0], w[1] - at[1]) == (-step[1], step[0])), ways[0])
                ways.remove(pick)
                at, came = pick, at
            n = len(ring)
            kept = [ring[i] for i in range(n) if not ((ring[i - 1][0] == ring[i][0] == ring[(i + 1) % n][0]) or (ring[i - 1][1] == ring[i][1] == ring[(i + 1) % n][1]))]
            rings.append([*kept, kept[0]])
    return rings


def _signed(ring: list[tuple[int, int]]) -> float:
    p = np.array(ring, float)
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def polygonise(raster: DataFrame, spec: GridSpec, ids: list[int] | None = None, split_sessions: bool = True, remove_dangles: bool = False, remove_holes: bool = False, tile: int = TILE) -> DataFrame:
    """(band, id, session, wkt, n_parts, area): a multipolygon of each positive value of a raster of whole numbers.

    With split_sessions a value that skips a row becomes two features. remove_dangles leaves only the largest part,
    remove_holes only outer rings. The last column counts like any other. Each 4-connected part is traced by itself, and
    of it only the cells with an open side, as many as its outline is long; corners are snapped to 1e-4.
    """
    held = raster.where(F.col("value").isNotNull() & (F.col("value") > 0))
    if ids:
        held = held.where(F.col("value").isin(ids))
    numbered = sessions(held) if split_sessions else held.withColumn("session", F.lit(1))
    code = numbered.select("band", "row", "col", (F.col("value").cast("long") * (1 << 22) + F.col("session")).cast("double").alias("value"))
    parts = components(code, tile=tile)
    across, along = Window.partitionBy("band", "region", "row").orderBy("col"), Window.partitionBy("band", "region", "col").orderBy("row")
    open_ = lambda c, over, step: F.coalesce(F.lag(c, step).over(over) != F.col(c) - step, F.lit(True))
    sides = parts.withColumns({"w": open_("col", across, 1), "e": open_("col", across, -1)}).withColumns({"u": open_("row", along, 1), "d": open_("row", along, -1)}).where("w or e or u or d")

    def trace(cells: pa.Table) -> pa.Table:
        rings = outline(*[cells.column(n).to_numpy() for n in ("row", "col", "u", "e", "d", "w")])
        outer = max(range(len(rings)), key=lambda i: abs(_signed(rings[i])))
        if remove_holes:
            rings, outer = [rings[outer]], 0
        area = sum(abs(_signed(r)) * (1 if i == outer else -1) for i, r in enumerate(rings)) * abs(spec.res_x * spec.res_y)
        ordered = [rings[outer], *[r for i, r in enumerate(rings) if i != outer]]
        text = "(" + ", ".join("(" + ", ".join(f"{round(spec.tlx + x * spec.res_x, 4)!r} {round(spec.tly + y * spec.res_y, 4)!r}" for x, y in ring) + ")" for ring in ordered) + ")"
        return pa.table({"band": cells.column("band").slice(0, 1), "code": pa.array([int(cells.column("value")[0].as_py())]), "region": cells.column("region").slice(0, 1), "part": [text], "area": [area]})

    traced = sides.groupBy("band", "region").applyInArrow(trace, "band int, code long, region long, part string, area double")
    keyed = traced.select("band", F.shiftright("code", 22).alias("id"), F.col("code").bitwiseAND((1 << 22) - 1).cast("int").alias("session"), "region", "part", "area")
    if remove_dangles:
        keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("band", "id", "session").orderBy(F.desc("area"), "region"))).where("_n = 1")
    shapes = keyed.groupBy("band", "id", "session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "part"))), lambda p: p["part"]), ", ").alias("_parts"), F.count(F.lit(1)).cast("int").alias("n_parts"), F.sum("area").alias("area"))
    return shapes.select("band", "id", "session", F.concat(F.lit("MULTIPOLYGON ("), "_parts", F.lit(")")).alias("wkt"), "n_parts", "area")
