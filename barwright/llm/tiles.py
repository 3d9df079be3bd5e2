"""Comparing the members of buckets, with buckets of any size and without emitting their pairs.

A bucket has homes and guests; every home is to be compared with every guest. Buckets with
one member are dropped by an aggregation. A large one is cut into tiles of at most about
``TILE`` homes by ``TILE`` guests, dealt to different tasks: no task holds a whole hot bucket.
Inside a task the rows of a tile stand together, and numpy compares them in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm.common import shuffled

TILE = 1024
# Pairs compared at once in a task: bounds memory, not results.
BLOCK = 1 << 20


def dealt(rows: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """Rows (key, id, home) of buckets with something to compare, cut into tiles and sorted.

    ``payload`` (id, ...) is joined to the rows that are left.
    """
    sizes = (
        rows.groupBy("key")
        .agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum((~F.col("home")).cast("long")).alias("g"))
        .where("h >= 1 and g >= 2")
        .select("key", F.ceil(F.col("h") / TILE).alias("th"), F.ceil(F.col("g") / TILE).alias("tg"))
    )
    live = rows.join(shuffled(sizes), "key")
    if payload is not None:
        live = live.join(shuffled(payload), "id")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("th")).otherwise(F.col("tg")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("home"), F.col("tg")).otherwise(F.col("th")) - 1))
    tiles = (
        live.withColumn("mine", mine)
        .withColumn("other", other)
        .withColumn("i", F.when(F.col("home"), F.col("mine")).otherwise(F.col("other")))
        .withColumn("j", F.when(F.col("home"), F.col("other")).otherwise(F.col("mine")))
        .drop("th", "tg", "mine", "other")
    )
    return tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (row of a home, row of a guest) over all tiles of a table of whole tiles."""
    key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    cut = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    tile = np.zeros(len(key), np.int64)
    tile[cut] = 1
    tile = np.cumsum(tile)
    guests = np.flatnonzero(~home)
    first = np.searchsorted(tile[guests], np.arange(len(cut) + 1))
    count = np.append(first[1:], len(guests)) - first
    homes = np.flatnonzero(home)
    homes = homes[count[tile[homes]] > 0]
    each = count[tile[homes]]
    total = np.cumsum(each)
    start = 0
    while start < len(homes):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + BLOCK, side="right")))
        n = each[start:stop]
        a = np.repeat(homes[start:stop], n)
        step = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        yield a, guests[np.repeat(first[tile[homes[start:stop]]], n) + step]
        start = stop


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole tiles: the last tile of a batch waits for the next batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j"))
        last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
        begin = int(last[-1]) + 1 if len(last) else 0
        if kept:
            t = kept[-1]
            same = all(t.column(t.schema.get_field_index(c))[-1].as_py() == x[0].item() for c, x in (("key", key), ("i", i), ("j", j)))
            if begin == 0 and same:
                kept.append(batch)
                continue
        if kept or begin:
            yield pa.Table.from_batches([*kept, batch.slice(0, begin)])
        kept = [batch.slice(begin)]
    if kept:
        yield pa.Table.from_batches(kept)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect what the links (a, b) connect: (id, smallest id of its component)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def mapped(rows: DataFrame, compare: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for table in whole_tiles(batches):
            yield from compare(table)

    return rows.mapInArrow(run, schema)
