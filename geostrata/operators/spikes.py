"""Implausible readings per source: impossible values, stuck values and spikes.

A robust exponentially weighted control chart follows each source in the order of its readings. It keeps the mean and
the scale of the change from one reading to the next, clips what lies beyond CLIP scales before it updates either,
suspects a change beyond LIMIT scales, and runs beside counters of equal values. Only a run of readings that the chart
suspects on the way in and on the way out can be a spike, and the chart also says what is normal: the source's normal
change starts from the largest change that the chart did not suspect and that the median of its scales bears, and rises
to the largest change between successive readings none of which stands out by more than LIMIT normal changes. The chart
holds while fewer than two in five of the changes that are not zero are disturbed.

Long sources are cut into blocks at quantiles of a bounded sample of their order values. Each block gets a halo of
readings of its neighbours, longer than the chart's memory and than any run that is tested, so the chart suspects the
same changes wherever the cuts are. What blocks say of a source (how often the chart had which scale, the largest
changes) is combined without loss into one normal change of the source, so the cuts leave no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import kdsplit

STUCK_RUN = 8
SPIKE_RUN = 5
LIMIT = 4.0
CLIP = 2.0
WEIGHT = 0.1
#: Changes that are not zero, from the first on, whose median the chart starts from.
FIRST = 64
#: Classes of scales and changes for each doubling.
CLASSES = 8
BLOCK_ROWS = 200_000
HALO_ROWS = 2000
#: With more blocks of one source than this, what they say is merged in parts first.
FAN = 256


def control_chart(changes: np.ndarray, weight: float = WEIGHT, limit: float = LIMIT, clip: float = CLIP) -> tuple[np.ndarray, np.ndarray]:
    """The scale before each change, and whether the change is suspected: itself or its distance from the mean is beyond limit scales.

    A change is clipped to clip scales around the mean before it updates mean and scale. A change of zero tells nothing of
    the scale and passes it by, so that coarse readings, which mostly repeat, have one.
    """
    moving = np.abs(changes[changes != 0])
    if not len(moving):
        return np.zeros(len(changes)), np.zeros(len(changes), bool)
    mean, scale = 0.0, float(np.median(moving[:FIRST]))
    scales, suspected = [], []
    for change in changes.tolist():
        scales.append(scale)
        if not change:
            suspected.append(False)
            continue
        off, bound = change - mean, limit * scale
        suspected.append(off > bound or off < -bound or change > bound or change < -bound)
        most = clip * scale
        if off > most:
            off = most
        elif off < -most:
            off = -most
        mean += weight * off
        held = mean + off
        scale += weight * ((held if held > 0 else -held) - scale)
        if scale < 1e-12:
            scale = 1e-12
    return np.array(scales), np.array(suspected)


def run_lengths(values: np.ndarray) -> np.ndarray:
    """Of each reading, the length of the run of equal values that it is in."""
    if not len(values):
        return np.zeros(0, np.int64)
    run = np.cumsum(np.r_[True, values[1:] != values[:-1]]) - 1
    return np.bincount(run)[run]


def excursions(values: np.ndarray, longest: int = SPIKE_RUN, suspected: np.ndarray | None = None) -> np.ndarray:
    """Of each reading, the largest h such that it is in a run of at most longest readings that all differ by h or more from the reading before the run and from the one after it.

    A reading between the two is on a slope and no excursion: as no undisturbed change is beyond a quarter of a spike's
    height, what comes before a spike and what comes after it lie on the same side of it. With suspected, a mark of each
    change, only runs count whose first and last change are marked.
    """
    n = len(values)
    best = np.zeros(n)
    for length in range(1, min(longest, n - 2) + 1):
        starts = n - length - 1
        before, after = values[:starts], values[length + 1 :]
        height = np.full(starts, np.inf)
        for k in range(1, length + 1):
            held = values[k : k + starts]
            off = np.minimum(np.abs(held - before), np.abs(held - after))
            height = np.minimum(height, np.where((held > before) == (held > after), off, 0.0))
        if suspected is not None:
            height = np.where(suspected[:starts] & suspected[length : length + starts], height, 0.0)
        for k in range(1, length + 1):
            best[k : k + starts] = np.maximum(best[k : k + starts], height)
    return best


def edge_excursions(values: np.ndarray, longest: int = SPIKE_RUN) -> np.ndarray:
    """As excursions, of runs at either end of a source, where there is a reading on one side alone. Such a run is no spike, but its changes are not taken for normal ones."""
    n = len(values)
    best = np.zeros(n)
    for held, out in ((values, best), (values[::-1], best[::-1])):
        for length in range(1, min(longest, n - 1) + 1):
            out[:length] = np.maximum(out[:length], np.abs(held[:length] - held[length]).min())
    return best


def raise_normal(normal: float, height: np.ndarray, change: np.ndarray, limit: float = LIMIT) -> float:
    """The least fixed point at or above normal: the largest change whose height is within the limit that it sets."""
    while True:
        within = change[height <= limit * normal]
        if not len(within) or within.max() <= normal:
            return normal
        normal = float(within.max())


def front(height: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can raise a normal change: those whose change is greater than all of no greater height. They are few."""
    order = np.lexsort((-change, height))
    height, change = height[order], change[order]
    record = np.r_[True, change[1:] > np.maximum.accumulate(change)[:-1]] if len(change) else np.zeros(0, bool)
    return height[record], change[record]


#: Kinds of what a block says: a reading, how often the chart had a class of scales, the largest change of a class that was not suspected, a pair of front().
READING, SCALES, QUIET, FRONT = range(4)


def _class(values: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(values, 1e-300)) * CLASSES).astype(np.int64)


def judge_block(values: np.ndarray, own: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of a block in order: the own readings to be judged, impossible, stuck, height as a possible spike, and what the block says of its source as (kind, a, b)."""
    possible = (values >= low) & (values <= high)
    stuck = run_lengths(values) >= STUCK_RUN
    kept = np.nonzero(possible)[0]
    held = values[kept]
    sound = ~stuck[kept]
    step = np.diff(held)
    pair = sound[1:] & sound[:-1] & (np.diff(kept) == 1)  # what an impossible reading hides is no change of one step
    scale, suspected = control_chart(step[pair])
    height = np.zeros(len(values))
    said = []
    if len(scale):
        # a step that is no change of one reading to the next is held against the scale that the chart has there
        known = np.where(pair, np.cumsum(pair) - 1, np.minimum(np.cumsum(pair), len(scale) - 1))
        marked = np.abs(step) > LIMIT * scale[known]
        marked[pair] = suspected
        height[kept] = excursions(held, suspected=marked)
        tall = np.maximum(excursions(held), edge_excursions(held))
        counted = pair & own[kept][1:]  # each change once, whatever the cuts
        change, over = np.abs(step[counted]), np.maximum(tall[1:], tall[:-1])[counted]
        here = counted[pair] & (step[pair] != 0)
        classes, times = np.unique(_class(scale[here]), return_counts=True)
        said.append((SCALES, classes, times))
        quiet = np.abs(step[pair])[here & ~suspected]
        of, at = np.unique(_class(quiet), return_inverse=True)
        most = np.zeros(len(of))
        np.maximum.at(most, at, quiet)
        said += [(QUIET, of, most), (FRONT, *front(over, change))]
    return np.nonzero(own & (~possible | stuck | (height > 0)))[0], ~possible, stuck, height, said


def merge_said(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What several blocks say of a source, as one block would say it."""
    out = []
    for k, join in ((SCALES, np.add), (QUIET, np.maximum)):
        of, at = np.unique(a[kind == k], return_inverse=True)
        held = np.zeros(len(of))
        join.at(held, at, b[kind == k])
        out.append((k, of, held))
    return [*out, (FRONT, *front(a[kind == FRONT], b[kind == FRONT]))]


def normal_change(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The normal change of a source out of what its blocks say: see the module."""
    (_, classes, times), (_, of, most), (_, height, change) = merge_said(kind, a, b)
    start = 0.0
    if len(classes):
        middle = classes[np.searchsorted(np.cumsum(times), times.sum() / 2)]
        borne = most[of <= middle + CLASSES * np.log2(LIMIT)]
        start = float(borne.max()) if len(borne) else 0.0
    return raise_normal(start, height, change)


def _blocks(readings: DataFrame, source: str, order: str, key: str, block_rows: int, halo_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each source longer than a block: the cuts between its blocks, and the halo's start and end at each cut."""
    rows, sample = kdsplit.bounded_sample(readings, key, [source, order])
    if rows <= block_rows or not len(sample):
        return {}
    share = min(1.0, len(sample) / rows)
    margin = int(np.ceil(halo_rows * share)) + 8
    sample = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    sources, first, counts = np.unique(sample[:, 0], return_index=True, return_counts=True)
    cuts = {}
    for s, begin, n in zip(sources, first, counts, strict=True):
        pieces = min(int(np.ceil(n / share / block_rows)), n // (2 * margin))
        if pieces >= 2:
            held = sample[begin : begin + n, 1]
            at = np.unique(np.arange(1, pieces) * n // pieces)
            cuts[int(s)] = (held[at], held[at - margin], held[np.minimum(at + margin, n - 1)])
    return cuts


def judge(readings: DataFrame, key: str, source: str, order: str, limits: dict[str, tuple[float, float]], block_rows: int = BLOCK_ROWS, halo_rows: int = HALO_ROWS) -> DataFrame:
    """(field, source, reading_id, impossible, stuck, spike, normal): each reading that is impossible, stuck or a spike of its source.

    limits gives the fields and the least and largest value that each can have. A reading is spike if the chart suspects
    the changes into and out of its run, and its height (see excursions) is beyond LIMIT times normal, the source's normal change. Null and NaN values are no readings, nor
    is a row without key, source or order; infinite values are impossible. A key delivered again counts once. Readings
    of equal order are taken by key. A source with fewer than three readings has no spikes. No rows give no rows. Other
    columns take no part.
    """
    held = readings.select(F.col(key).cast("long").alias("_key"), F.col(source).cast("long").alias("_source"), F.col(order).cast("double").alias("_order"), *[F.col(f).cast("double").alias(f"_v{i}") for i, f in enumerate(limits)])
    held = held.where(F.col("_key").isNotNull() & F.col("_source").isNotNull() & F.col("_order").isNotNull() & ~F.isnan("_order"))
    names = list(limits)
    bound = [limits[n] for n in names]
    cuts = _blocks(held, "_source", "_order", "_key", block_rows, halo_rows)
    middle = "field int, source long, block long, own boolean, key long, at double, value double"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sources, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            row, block, own = np.arange(len(keys)), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
            for s in np.intersect1d(np.unique(sources), list(cuts)) if cuts else ():
                cut, start, end = cuts[int(s)]
                mine = np.nonzero(sources == s)[0]
                home = np.searchsorted(cut, at[mine], "right")
                block[mine] = home
                for step in range(len(cut)):  # the halo at each cut goes to the block beyond it
                    left = mine[(home <= step) & (at[mine] >= start[step])]
                    right = mine[(home > step) & (at[mine] <= end[step])]
                    row = np.concatenate([row, left, right])
                    block = np.concatenate([block, np.full(len(left), step + 1), np.full(len(right), step)])
                    own = np.concatenate([own, np.zeros(len(left) + len(right), bool)])
            for i in range(len(names)):
                value = batch.column(3 + i).to_numpy(zero_copy_only=False)[row]
                there = ~np.isnan(value)
                pick = row[there]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), i, np.int32)), pa.array(sources[pick]), pa.array(block[there]), pa.array(own[there]), pa.array(keys[pick]), pa.array(at[pick]), pa.array(value[there])], names=["field", "source", "block", "own", "key", "at", "value"])

    def in_block(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).to_numpy() for c in ("own", "key", "at", "value")}
        _, first = np.unique(column["key"], return_index=True)
        first = first[np.lexsort((column["key"][first], column["at"][first]))]
        keys, values, own = (column[c][first] for c in ("key", "value", "own"))
        field, source_ = group.column("field")[0].as_py(), group.column("source")[0].as_py()
        rows, impossible, stuck, height, said = judge_block(values, own, *bound[field])
        n = len(rows)
        kind, a, b = (np.concatenate([np.zeros(0), *parts]) for parts in ([np.full(len(x), k) for k, x, _ in said], [x for _, x, _ in said], [y for _, _, y in said]))
        m = len(kind)
        return pa.table({
            "field": np.full(n + m, field, np.int32), "source": np.full(n + m, source_), "part": np.full(n + m, group.column("block")[0].as_py() // FAN), "kind": np.concatenate([np.zeros(n), kind]).astype(np.int32),
            "key": np.concatenate([keys[rows], np.zeros(m, np.int64)]), "impossible": np.concatenate([impossible[rows], np.zeros(m, bool)]), "stuck": np.concatenate([stuck[rows], np.zeros(m, bool)]),
            "a": np.concatenate([height[rows], a]), "b": np.concatenate([np.zeros(n), b]),
        })

    def in_part(group: pa.Table) -> pa.Table:
        said = merge_said(*(group.column(c).to_numpy() for c in ("kind", "a", "b")))
        kind, a, b = np.concatenate([np.full(len(x), k, np.int32) for k, x, _ in said]), *(np.concatenate([s[i].astype(float) for s in said]) for i in (1, 2))
        return pa.table({"field": np.full(len(kind), group.column("field")[0].as_py(), np.int32), "source": np.full(len(kind), group.column("source")[0].as_py()), "kind": kind, "a": a, "b": b})

    def in_source(group: pa.Table) -> pa.Table:
        normal = normal_change(*(group.column(c).to_numpy() for c in ("kind", "a", "b")))
        return pa.table({"field": group.column("field").slice(0, 1), "source": group.column("source").slice(0, 1), "normal": [normal]})

    judged = cut(held.mapInArrow(send, middle).groupBy("field", "source", "block").applyInArrow(in_block, "field int, source long, part long, kind int, key long, impossible boolean, stuck boolean, a double, b double"))
    said = judged.where(F.col("kind") != READING).select("field", "source", "part", "kind", "a", "b")
    if max((len(c[0]) for c in cuts.values()), default=0) >= FAN:
        said = said.groupBy("field", "source", "part").applyInArrow(in_part, "field int, source long, kind int, a double, b double")
    normals = said.select("field", "source", "kind", "a", "b").groupBy("field", "source").applyInArrow(in_source, "field int, source long, normal double")
    # a source may have any number of suspects, so they meet its one row of normals in a join and not in a group
    suspects = judged.where(F.col("kind") == READING).withColumnRenamed("a", "height").join(normals, ["field", "source"], "left")
    spike = F.coalesce(F.col("height") > LIMIT * F.col("normal"), F.lit(False))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("field") + 1)
    found = suspects.where(F.col("impossible") | F.col("stuck") | spike)
    return found.select(name.alias("field"), "source", F.col("key").alias("reading_id"), "impossible", "stuck", F.when(spike, F.col("height")).otherwise(0.0).alias("spike"), F.coalesce("normal", F.lit(0.0)).alias("normal"))
