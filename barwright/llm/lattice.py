"""Near-duplicate embeddings by lattice hashing with E8.

Each of ``TABLES`` tables projects a unit vector to eight random directions, divides by
``WIDTH`` and decodes the point to the nearest point of the lattice E8, its home cell. A
vector also visits the ``PROBES`` neighbouring cells nearest to it. Two vectors meet where one
is at home in a cell that the other visits, and their cosine is then computed in double
precision. Equal vectors are one class with a number of members, so copies are never paired.

A pair that meets in several tables counts in the first; which that is follows from the
cells of the two vectors, so pairs need not be gathered to be counted: tasks give sums of
links and as few links as connect what they found. A narrower ``WIDTH`` with more ``TABLES``
keeps cells small in a larger corpus; chance of meeting by cosine is in the README.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.llm import tiles
from barwright.llm.common import components, stored

NAME = "op2_embedding_dedup"
SQL = None
THRESHOLD = 0.9
TABLES = 6
PROBES = 4
WIDTH = 0.45
SEED = 8
# Pairs whose vectors stand side by side: bounds memory.
SIDE = 1 << 15


@cache
def roots() -> tuple[np.ndarray, np.ndarray]:
    """The 240 shortest vectors of E8: two coordinates of one, or all of a half with an even number of minus signs."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, j, s, t) in enumerate(pairs):
        whole[k, i], whole[k, j] = s, t
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return whole, half


@cache
def directions(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(tables, 8, dim)) / np.sqrt(8)


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the nearer of the nearest points of D8 and of D8 moved by halves."""

    def d8(v):
        f = np.rint(v)
        r = v - f
        row = np.arange(len(v))
        worst = np.abs(r).argmax(1)
        odd = f.sum(1) % 2 != 0
        f[row[odd], worst[odd]] += np.where(r[row, worst] >= 0, 1.0, -1.0)[odd]
        return f

    a, b = d8(y), d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> np.ndarray:
    """Keys (row, table, 1 + probes) of the cells that unit vectors visit, the home cell first.

    All sums run in a fixed order, so a vector has the same cells wherever it is computed.
    """
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    whole, half = roots()
    for t in range(tables):
        y = np.empty((len(x), 8))
        for k in range(8):
            y[:, k] = (x * directions(x.shape[1], tables)[t, k]).sum(1) / width
        home = decode(y)
        r = y - home
        toward = []
        for table in (whole, half):
            total = np.zeros((len(x), len(table)))
            for k in range(8):
                total += r[:, k : k + 1] * table[:, k]
            toward.append(total)
        order = np.argsort(-np.concatenate(toward, 1), axis=1, kind="stable")[:, :probes]
        steps = np.concatenate([whole, half])[order]
        points = np.concatenate([home[:, None], home[:, None] + steps], 1)
        h = np.full(points.shape[:2], np.uint64(x.shape[1] * 1009 + t + 1))
        for k in range(8):
            h = (h ^ (points[:, :, k] * 2).astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, t] = h.view(np.int64)
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each dimension that occurs."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.list_(pa.float32()))
    size = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy().astype(np.float64)
    begin = a.offsets.to_numpy()[:-1] - a.offsets.to_numpy()[0] if len(a) else np.zeros(0, np.int64)
    out = []
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        x = flat[begin[at][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(1, keepdims=True)
        out.append((at, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def visits(classes: DataFrame, tables: int, probes: int, width: float) -> DataFrame:
    """(key, id, home) of every class at home and as a guest."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, x in matrix(batch.column(1)):
                for i in range(0, len(at), 2048):
                    key = cells(x[i : i + 2048], tables, probes, width)
                    mine = ids[at[i : i + 2048]]
                    home = key[:, :, 0].ravel()
                    guest = key.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([home, guest])),
                            pa.array(np.concatenate([np.repeat(mine, tables), np.repeat(mine, tables * (1 + probes))])),
                            pa.array(np.arange(len(home) + len(guest)) < len(home)),
                        ],
                        names=["key", "id", "home"],
                    )

    return classes.select("id", "embedding").mapInArrow(work, "key long, id long, home boolean")


def found(classes: DataFrame, threshold: float, tables: int, probes: int, width: float) -> DataFrame:
    """(a, b, n): links b < a that connect the classes, and (a, NULL, n): n more members linked with class a."""

    def compare(table: pa.Table):
        where = np.empty(table.num_rows, np.int64)
        spaces = matrix(table.column("embedding"))
        if len(spaces) > 1:
            for at, _ in spaces:
                yield from compare(table.take(pa.array(at)))
            return
        if not spaces:
            return
        where[spaces[0][0]] = np.arange(table.num_rows)
        x = spaces[0][1][where]
        short = x.astype(np.float32)
        ids, members, key = (table.column(c).to_numpy() for c in ("id", "members", "key"))
        for a, b in tiles.pairs(table):
            near = []
            for i in range(0, len(a), SIDE):
                s = np.einsum("ij,ij->i", short[a[i : i + SIDE]], short[b[i : i + SIDE]])
                near.append(i + np.flatnonzero((s >= threshold - 1e-4) & (ids[a[i : i + SIDE]] != ids[b[i : i + SIDE]])))
            near = np.concatenate(near)
            exact = np.concatenate([np.zeros(0, bool), *[(x[a[near[i : i + SIDE]]] * x[b[near[i : i + SIDE]]]).sum(1) >= threshold for i in range(0, len(near), SIDE)]])
            a, b = a[near[exact]], b[near[exact]]
            if not len(a):
                continue
            low, high = tiles.forest(ids[a], ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(np.zeros(len(low), np.int64))], names=["a", "b", "n"])
            # Which of the meetings of a pair is this? Only the first counts.
            rows, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            c = cells(x[rows], tables, probes, width)
            for i in range(0, len(a), SIDE):
                u, v = back[: len(a)][i : i + SIDE], back[len(a) :][i : i + SIDE]
                k = key[a[i : i + SIDE]]
                one = (c[u, :, :1] == c[v]).any(2)  # u is at home where v visits
                two = (c[v, :, :1] == c[u]).any(2)
                t = (c[u, :, 0] == k[:, None]).argmax(1)
                first = (one | two).argmax(1)
                row = np.arange(len(t))
                count = (first == t) & ((ids[a[i : i + SIDE]] < ids[b[i : i + SIDE]]) | ~two[row, t])
                p, q = a[i : i + SIDE][count], b[i : i + SIDE][count]
                who, at = np.unique(np.concatenate([ids[p], ids[q]]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([members[q], members[p]]), minlength=len(who))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(total.astype(np.int64))], names=["a", "b", "n"])

    rows = tiles.dealt(visits(classes, tables, probes, width), classes)
    return tiles.mapped(rows, compare, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components, or have no
    vec_id, link with nothing; vectors of different lengths do not link. Rows that repeat a
    vec_id are vectors of their own that share its component. An empty table gives no rows;
    other columns are ignored.
    """
    sound = F.coalesce(
        F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), sound.alias("sound"))
    classes = rows.where("sound").groupBy("embedding").agg(F.count("*").alias("members"), F.min("vec_id").alias("first"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "lattice-classes")
    links = stored(found(classes.select("id", "embedding", "members"), threshold, tables, probes, width), "lattice-links")
    sums = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    root = components(links.where("b is not null").select("a", "b"), "lattice-components")
    named = (
        classes.join(sums, "id", "left")
        .join(root, classes.id == root.node, "left")
        .select("embedding", "first", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "root").select("embedding", "n_links", "component_id")
    good = rows.where("sound").join(named, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.unionAll(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
