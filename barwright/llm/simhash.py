"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks so that two fingerprints within the threshold differ
in at most one bit in some block (two blocks of 32 bits for three bits). In a block the
anchors are the words of a covering code: a perfect Hamming code over the first 2^r - 1
bits, every value of the rest, covering radius 1. A block within distance 1 of its home
anchor and another block within distance 1 of the first lie within distance 2 of that anchor,
so each fingerprint is replicated to every anchor within radius plus threshold (17 of a
32-bit block at most), and compared there with the fingerprints at home. One code over all
64 bits would need some 10^4 replicas; blocks are the same covering with a threshold of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barwright.llm import tiles
from barwright.llm.common import SPACE, ascii_lower, components, documents, shuffled, stored

NAME = "op1_simhash"
WIDTH = 3
THRESHOLD = 3
SQL = None


def signed(bits: int) -> int:
    """64 bits as Spark's long holds them."""
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def shingles(text: Column, words: str = "words") -> Column:
    n = F.size(words)
    at = lambda i: F.get(words, i)
    runs = F.transform(
        F.sequence(F.lit(0), n - WIDTH), lambda i: F.concat_ws(" ", *[at(i + k) for k in range(WIDTH)])
    )
    return F.when(n >= WIDTH, runs).when(n > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row: the majority of each bit over XXH64 of its 3-word shingles.

    NULL and empty texts have the fingerprint zero. Repeated rows stay rows of their own.
    """
    edge = " \t\n\x0b\x0c\r"
    text = F.btrim(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(edge))
    words = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.when(text != "", F.split(text, SPACE + "+")).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    each = words.select("row", "doc_id", F.explode_outer(shingles(F.col("words"))).alias("s"))
    each = each.select("row", "doc_id", "s", F.xxhash64("s").alias("h"))
    # Two counters of 32 bits in one sum: bit i and bit i + 32.
    pair = (1 << 32) | 1
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(pair))).alias(f"c{i}") for i in range(32)]
    counts = each.groupBy("row", "doc_id").agg(F.count("s").alias("n"), *sums)
    low = lambda i: F.col(f"c{i}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("n")
    high = lambda i: F.shiftrightunsigned(f"c{i}", 32) * 2 > F.col("n")
    fp = F.lit(0).cast("long")
    for i in range(32):
        fp = fp.bitwiseOR(F.when(low(i), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        fp = fp.bitwiseOR(F.when(high(i), F.lit(signed(1 << (i + 32))).cast("long")).otherwise(F.lit(0).cast("long")))
    return counts.select("doc_id", F.when(F.col("n") > 0, fp).otherwise(F.lit(0).cast("long")).alias("fp"))


def flips(width: int) -> list[list[int]]:
    """By syndrome, the masks that lead from a block to each anchor within distance 2; the home first."""
    r = (width + 1).bit_length() - 1
    n = (1 << r) - 1
    free = list(range(n, width))
    # Bit p of the block stands at position p + 1 of the Hamming code; its syndrome is p + 1.
    out = []
    for s in range(n + 1):
        home = 0 if s == 0 else 1 << (s - 1)
        masks = [home] + [home | 1 << f for f in free]
        if s == 0:
            masks += [1 << f | 1 << g for k, f in enumerate(free) for g in free[k + 1 :]]
        else:
            masks += [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, n + 1) if a < a ^ s]
        out.append(masks)
    return out


def syndrome(block: Column, width: int) -> Column:
    r = (width + 1).bit_length() - 1
    out = F.lit(0)
    for k in range(r):
        mask = sum(1 << (s - 1) for s in range(1, 1 << r) if s >> k & 1)
        out = out + F.bit_count(block.bitwiseAND(F.lit(signed(mask)).cast("long"))) % 2 * (1 << k)
    return out


def anchors(fps: DataFrame, threshold: int) -> DataFrame:
    """(key, id, home): each fingerprint at every anchor within reach, in each block."""
    blocks = threshold // 2 + 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        block = F.shiftrightunsigned("id", a).bitwiseAND(F.lit(signed((1 << (b - a)) - 1)).cast("long"))
        table = F.array(*[F.array(*[F.lit(signed(m)).cast("long") for m in row]) for row in flips(b - a)])
        rows = fps.select("id", block.alias("block")).select(
            "id", "block", F.posexplode(F.element_at(table, (syndrome(F.col("block"), b - a) + 1).cast("int"))).alias("p", "m")
        )
        anchor = F.col("block").bitwiseXOR(F.col("m"))
        # A fingerprint at home is also a guest there; the block's number tells the codes apart.
        rows = rows.select(
            (F.shiftleft(anchor, 4) + F.lit(k)).alias("key") if b - a < 60 else F.xxhash64(F.lit(k), anchor).alias("key"),
            "id",
            F.explode(F.when(F.col("p") == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("home"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``id`` within ``threshold`` bits."""

    def compare(table: pa.Table):
        ids = table.column("id").to_numpy()
        for a, b in tiles.pairs(table):
            near = np.bitwise_count((ids[a] ^ ids[b]).view(np.uint64)) <= threshold
            near &= ids[a] != ids[b]
            if near.any():
                x, y = tiles.forest(ids[a[near]], ids[b[near]])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return tiles.mapped(tiles.dealt(anchors(fps, threshold)), compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id of the rows reachable by fingerprints that differ in
    ``threshold`` bits at most. Rows without doc_id link others but never name a component
    (NULL if all of it lack one). An empty table gives no rows. Other columns are ignored.
    """
    marked = stored(fingerprints(docs), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    root = components(links(marked.select(F.col("fp").alias("id")).distinct(), threshold), "simhash-links")
    named = classes.join(shuffled(root), classes.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-classes")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(shuffled(lowest), "root").select("fp", "component_id")
    return marked.join(shuffled(named), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component; rows without doc_id stay.

    Should several rows hold that doc_id, the longest text stays.
    """
    stay = near_duplicates(docs.select("doc_id", "text"), threshold).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(shuffled(stay), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
    kept = kept.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
