"""Exact duplicates through an extendible-hash index kept as files in the shared folder.

Hashes of normalised texts fall into buckets by their leading bits. The directory starts with
one bucket and doubles: a bucket that holds more than ``CAPACITY`` distinct hashes splits by
one more bit, until it fits or ``MAX_DEPTH`` is reached (a deeper bucket only grows longer
chains; nothing is lost). Equal texts are combined before they move, by comparing all their
bytes; each owner task then gets a range of (bucket, hash), chains texts whose hashes
collide, and writes its part of the index. Documents look their text up in the index by hash
and digest. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barwright.llm.common import SPACE, documents, shuffled, stored

NAME = "op10_exact_dedup"
CAPACITY = 100_000
# The directory has 2^MAX_DEPTH rows at most; this bounds what is broadcast.
MAX_DEPTH = 14
_SHIFT = "36893488147419103232"  # 2^65
_TOP = "9223372036854775808"  # 2^63


def normalised(column: str = "text"):
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACE + "+", "")


def directory(hashes: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket, depth) of every slot in use: slots are the leading ``max_depth`` bits.

    A bucket's depth is the smallest at which its leading bits hold ``capacity`` distinct
    hashes or fewer, which is where repeated doubling leaves it; it is named by its first slot.
    """
    slots = hashes.distinct().groupBy(F.shiftrightunsigned("h", 64 - max_depth).alias("slot")).agg(F.count("*").alias("n"))
    at = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {max_depth} - depth), {max_depth} - depth)")
    at = at.withColumn("bucket", first)
    fits = at.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    return (
        at.join(fits, ["depth", "bucket"])
        .groupBy("slot")
        .agg(F.min("depth").alias("depth"))
        .withColumn("bucket", first)
        .select("slot", "bucket", "depth")
    )


def index(docs: DataFrame, marked: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(bucket, h, chain, text_sha256, keep_id, chars, group_size): one entry for each distinct text, on shared files."""
    slots = F.broadcast(directory(marked.select("h"), capacity, max_depth))
    rows = docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), normalised().alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    rows = rows.withColumn("slot", F.shiftrightunsigned("h", 64 - max_depth)).join(slots, "slot")
    # chars, then the smallest doc_id, in one number: it sits in a fixed-width buffer, so equal
    # texts combine by hashing before they move. A missing doc_id comes last.
    late = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    best = F.col("chars").cast("decimal(10,0)") * F.lit(_SHIFT).cast("decimal(20,0)") + late.cast("decimal(20,0)")
    entries = rows.groupBy("bucket", "h", "norm").agg(F.count("*").alias("group_size"), F.max(best.cast("decimal(38,0)")).alias("best"))
    left = (F.col("best") % F.lit(_SHIFT).cast("decimal(38,0)")).cast("decimal(20,0)")
    entries = entries.select(
        "bucket",
        "h",
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(left > 0, (F.lit(_TOP).cast("decimal(20,0)") - left).cast("long")).alias("keep_id"),
        "group_size",
    )
    chain = Window.partitionBy("bucket", "h").orderBy("text_sha256")
    return stored(
        entries.repartitionByRange("bucket", "h").withColumn("chain", F.row_number().over(chain)), "exact-index"
    )


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text).

    NULL counts as empty. Of equal texts the row with the most code points in its original
    text stays, then the smallest doc_id, a missing doc_id last. Of rows that repeat that
    doc_id in the group only one is kept, the one with the most code points. An empty table
    gives no rows; other columns are ignored.
    """
    norm = normalised()
    marked = stored(
        docs.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), norm.alias("norm")).select(
            "doc_id", "chars", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256")
        ),
        "exact-keys",
    )
    found = index(docs, marked, capacity, max_depth).select("h", "text_sha256", "keep_id", "group_size")
    rows = marked.join(shuffled(found), ["h", "text_sha256"])
    one = Window.partitionBy("text_sha256", "doc_id").orderBy(F.col("chars").desc())
    first = (F.row_number().over(one) == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256")


def without_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in :func:`exact_duplicates`."""
    stay = exact_duplicates(docs.select("doc_id", "text"), capacity, max_depth).where("kept")
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__sha256", F.sha2(normalised(), 256))
    kept = keyed.join(shuffled(stay), keyed["doc_id"].eqNullSafe(stay["__id"]) & (keyed["__sha256"] == stay["__sha"]))
    one = Window.partitionBy("__sha256", "doc_id").orderBy(F.char_length("text").desc_nulls_last(), F.xxhash64("text"))
    return kept.withColumn("__rank", F.row_number().over(one)).where("__rank = 1").select(*[keyed[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256, doc_id ORDER BY chars DESC) AS n
  FROM d
)
SELECT doc_id, keep_id, group_size, n = 1 AND doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
