"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups.

Documents fall into groups of about GROUP_ROWS by a hash of their keys, whatever their lengths or sources. In a group
the items are taken from the largest to the smallest, and each goes into the first container that still has room. A
tournament tree over the containers' free room finds it in logarithmic time. Only an item that alone exceeds the
capacity is split, into full containers and a rest that is packed like an item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZERS, count_tokens

GROUP_ROWS = 20_000
MOST_SPECS = 100


class FreeRoom:
    """Tournament tree: each node has the most free room of the containers below it; all containers start empty."""

    def __init__(self, containers: int, capacity: int):
        self.width = 1
        while self.width < max(1, containers):
            self.width *= 2
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        """The first container with room for size, which it takes."""
        best, node = self.best, 1
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        at = node - self.width
        node //= 2
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left >= right else right
            node //= 2
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item of at most capacity; of equal sizes the first comes first."""
    out = np.zeros(len(sizes), np.int64)
    # two containers that are both half full are never left side by side, so this many are enough
    tree = FreeRoom(min(len(sizes), int(2 * sizes.sum() // capacity) + 2), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = tree.place(int(sizes[i]))
    return out


def pack(items: DataFrame, key: str, size: str, specs: DataFrame, group_rows: int = GROUP_ROWS, rows: int | None = None) -> DataFrame:
    """(spec_id, container, key, part, first_token, tokens): every item in a container of every spec.

    items have a key and a size, specs a spec_id and a capacity of at least 1. An item of size 0 takes no room and goes
    into the first container of its group. An item that exceeds the capacity comes in parts, numbered from 0, that say
    where they begin. Items of null key or size and specs of null or smaller capacity take no part; repeated keys are
    items of their own. No items or no specs give no rows. rows is the number of items, where it is known already. Other columns take no part.
    """
    held = items.select(F.col(key).cast("long").alias("_key"), F.col(size).cast("long").alias("_size")).where("_key is not null and _size >= 0")
    groups = max(1, -(-(items.count() if rows is None else rows) // group_rows))
    wanted = specs.select(F.col("spec_id").cast("int"), F.col("capacity").cast("long")).where("spec_id is not null and capacity >= 1")
    some = wanted.limit(MOST_SPECS + 1).collect()
    if len(some) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs: pack them in several calls")
    # every item is packed once for each spec; their number is checked above
    each = F.array(*[F.struct(F.lit(int(s)).alias("spec_id"), F.lit(int(c)).cast("long").alias("capacity")) for s, c in some]).cast("array<struct<spec_id:int,capacity:bigint>>")
    grouped = held.withColumn("_group", F.pmod(F.xxhash64(F.lit(11), "_key"), F.lit(groups))).select("_key", "_size", "_group", F.inline(each))

    def fill(batch: pa.Table) -> pa.Table:
        capacity, group, spec = batch.column("capacity")[0].as_py(), batch.column("_group")[0].as_py(), batch.column("spec_id")[0].as_py()
        keys, sizes = batch.column("_key").to_numpy(), batch.column("_size").to_numpy()
        order = np.lexsort((sizes, keys))
        keys, sizes = keys[order], sizes[order]
        parts = np.maximum(1, -(-sizes // capacity))
        of = np.repeat(np.arange(len(keys)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        tokens = np.minimum(capacity, sizes[of] - part * capacity)
        container = first_fit_decreasing(tokens, capacity)
        n = len(of)
        return pa.table({"spec_id": np.full(n, spec, np.int32), "container": group * (1 << 32) + container, key: keys[of], "part": part.astype(np.int32), "first_token": part * capacity, "tokens": tokens})

    return grouped.groupBy("spec_id", "_group").applyInArrow(fill, f"spec_id int, container long, {key} long, part int, first_token long, tokens long")


def pack_documents(documents: DataFrame, key: str, text: str, specs: DataFrame, folder: str = TOKENIZERS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pack() of documents as long as their texts have tokens of each spec's tokenizer; a null text has none.

    A spec without a tokenizer takes no part. More than MOST_SPECS tokenizers are an error.
    """
    tokenizers = [r[0] for r in specs.where("tokenizer is not null and spec_id is not null and capacity >= 1").select("tokenizer").distinct().orderBy("tokenizer").limit(MOST_SPECS + 1).collect()]
    if len(tokenizers) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} tokenizers: pack them in several calls")
    packed, rows = None, documents.count()
    for tokenizer in tokenizers:
        one = pack(count_tokens(documents, key, text, tokenizer, folder), key, "tokens", specs.where(F.col("tokenizer") == tokenizer), group_rows, rows)
        packed = one if packed is None else packed.unionByName(one)
    if packed is None:
        packed = documents.sparkSession.createDataFrame([], f"spec_id int, container long, {key} long, part int, first_token long, tokens long")
    return packed
