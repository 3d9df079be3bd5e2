"""Prefix trie of conversations, rolled up by depth bands.

A node is a sequence of first turns. Its key is a digest of the band of ``BAND`` turns that it
lies in, up to its own turn, and of the bands before, so that no task needs a whole
conversation: turns are gathered by (conversation, band), ``BAND`` at a time, and the digests
of full bands are chained in the same way, bands of bands.

Totals over subtrees: nodes go to their ancestors inside their own band only. A node is owned
by its smallest member, which then owns all later nodes on its path, so that a conversation
sends one row of suffix sums to each ancestor in a band and not one for each pair. Band roots
form a trie of their own, ``BAND`` times lower, whose nodes hold the sums of the bands below;
it is rolled up likewise, and its completed totals join the last nodes of the bands above
before these are exploded. Rounds grow with the logarithm of the depth, rows with the nodes.

Turns are numbered without gathering a conversation: they are dealt out by ranges of their
order, and the turns of a conversation in earlier ranges are added to the place in its own.
Texts never move, only their digests and lengths.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barwright.llm.common import stored

NAME = "op12_prefix_trie"
#: Height of a band: turns gathered at a time, and ancestors that a row goes to.
BAND = 32
VALUES = ["n_leaves", "saved_tokens"]


def root_key() -> Column:
    """Key of the textless root."""
    return F.unhex(F.lit("00" * 32))


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _band(i: Column, band: int) -> Column:
    return F.floor((i - 1) / band).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` reads it within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, bytes): turns of ``conversations`` (conv_id, turn, role, text) in order, i from 1.

    The order is turn, NULL first; ties go by the digest of role and text; equal rows count
    each. A NULL role or text is empty. Rows without conv_id are left out. ``bytes`` is the
    length of the text in UTF-8. Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        "conv_id",
        "turn",
        _sha(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "bytes"), "turns")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    # One row for each conversation and range that it lies in.
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    place = F.col("at") - F.col("first") + F.col("earlier") + 1
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", place.alias("i"), "digest", "bytes")


def head(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation begins as conv_id - conv_id % 5 does.

    ``turns`` is as :func:`numbered` gives it. The first head(conv_id) turns are those of that
    other conversation, as many as it has, followed by its own after head(conv_id). The
    remainder of a negative conv_id is negative, as in SQL. Conversations: (conv_id, size),
    with those left without turns.
    """
    every = stored(turns.groupBy("conv_id").agg(F.max("i").alias("n")), "conversations")
    base = every.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    every = every.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", head(F.col("conv_id")))
    every = every.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    every = stored(every.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    own = turns.join(every.select("conv_id", "h", "taken"), "conv_id").where("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "digest", "bytes")
    # Eight turns at most of each, for the nine conversations at most that begin with them.
    first = turns.where("i <= 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    first = first.join(every.where("taken > 0").select("conv_id", "base", "taken"), "base").where("i <= taken")
    return own.unionAll(first.select("conv_id", "i", "digest", "bytes")), every.select("conv_id", "size")


def paths(turns: DataFrame, longest: int, band: int = BAND) -> DataFrame:
    """(conv_id, band, above, keys, bytes): the nodes that each conversation passes, band by band.

    ``above`` is the key of the node that the band hangs from, ``keys`` those of the nodes in it.
    """
    items = F.array_sort(F.collect_list(F.struct("i", "digest", "bytes")))
    rows = turns.groupBy("conv_id", _band(F.col("i"), band).alias("band")).agg(items.alias("items"))
    first = F.slice(F.transform("items", lambda t: t.digest), 1, 1)
    chain = F.aggregate(
        F.slice("items", F.lit(2), F.lit(band)), first, lambda a, t: F.concat(a, F.array(_sha(F.element_at(a, -1), t.digest)))
    )
    rows = rows.select("conv_id", "band", chain.alias("chain"), F.transform("items", lambda t: t.bytes).alias("bytes"))
    keys = F.transform("chain", lambda c: _sha(F.col("above"), c))
    if longest <= band:
        rows = rows.withColumn("above", root_key())
    else:
        rows = stored(rows, "bands")
        # Full bands are the turns of conversations ``band`` times shorter, whose nodes are the band roots.
        full = rows.where(F.size("bytes") == band).select(
            "conv_id", (F.col("band") + 1).alias("i"), F.element_at("chain", -1).alias("digest"), F.lit(0).cast("long").alias("bytes")
        )
        upper = paths(full, longest // band, band).select("conv_id", "band", F.posexplode("keys").alias("k", "root"))
        upper = stored(upper.select("conv_id", (F.col("band") * band + F.col("k") + 1).alias("band"), "root"), "roots")
        rows = rows.join(upper.withColumnRenamed("root", "above"), ["conv_id", "band"], "left")
        last = upper.select("conv_id", (F.col("band") - 1).alias("band"), F.col("root").alias("last"))
        rows = rows.join(last, ["conv_id", "band"], "left").withColumn("above", F.coalesce("above", root_key()))
        # A band root is the last node of the band above it.
        keys = F.when(F.col("last").isNull(), keys).otherwise(F.concat(F.slice(keys, 1, band - 1), F.array("last")))
    return rows.select("conv_id", "band", "above", keys.alias("keys"), "bytes")


def rolled(bands: DataFrame, nodes: DataFrame, longest: int, band: int = BAND) -> DataFrame:
    """(key, n_leaves, saved_tokens): totals over the subtree of every node.

    ``bands`` (conv_id, band, above, keys) are the paths of all conversations, ``nodes``
    (conv_id, depth, n_leaves, saved_tokens) the nodes' own values, under their owner.
    """
    own = F.array_sort(F.collect_list(F.struct("depth", *VALUES)))
    own = nodes.groupBy("conv_id", _band(F.col("depth"), band).alias("band")).agg(own.alias("own"))
    # What a conversation owns of a band stands at its end.
    owned = bands.select("conv_id", "band", "above", "keys").join(own, ["conv_id", "band"])
    owned = owned.select("conv_id", "band", "above", "keys", *[F.col(f"own.{v}").alias(v) for v in VALUES])
    if longest > band:
        owned = stored(owned, "owned")
        total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
        below = owned.select(F.col("above").alias("key"), *[total(v).alias(v) for v in VALUES])
        below = below.groupBy("key").agg(*[F.sum(v).alias(v) for v in VALUES])
        last = F.element_at("keys", -1)
        full = bands.where(F.size("keys") == band).select("conv_id", (F.col("band") + 1).alias("i"), last.alias("key"), "above")
        items = F.array_sort(F.collect_list(F.struct("i", "key", "above")))
        upper = full.groupBy("conv_id", _band(F.col("i"), band).alias("band")).agg(items.alias("items"))
        upper = upper.select("conv_id", "band", F.col("items")[0]["above"].alias("above"), F.transform("items", lambda t: t.key).alias("keys"))
        roots = owned.where(F.size("keys") == band).select("conv_id", (F.col("band") + 1).alias("depth"), last.alias("key"))
        roots = roots.join(below, "key", "left").select("conv_id", "depth", *[F.coalesce(v, F.lit(0)).alias(v) for v in VALUES])
        done = stored(rolled(stored(upper, "band-paths"), stored(roots, "band-roots"), longest // band, band), "band-totals")
        done = done.select(F.col("key").alias("last"), *[F.col(v).alias(f"{v}_below") for v in VALUES])
        ends = owned.where(F.size("keys") == band).withColumn("last", last).join(done, "last")
        more = lambda v: F.transform(v, lambda x, k: x + F.when(k == F.size(v) - 1, F.col(f"{v}_below")).otherwise(0))
        ends = ends.select("conv_id", "band", "above", "keys", *[more(v).alias(v) for v in VALUES])
        owned = owned.where(F.size("keys") < band).unionByName(ends)
    # Sums from each owned place to the end; ancestors owned by others get the whole sum.
    later = lambda v: F.reverse(F.aggregate(
        F.reverse(v), F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x))
    ))
    given = _bound(
        F.struct(F.col("keys"), *[later(v).alias(v) for v in VALUES]),
        lambda s: F.transform(
            s["keys"],
            lambda key, k: F.struct(key.alias("key"), *[F.get(s[v], F.greatest(k - F.size(s["keys"]) + F.size(s[v]), F.lit(0))).alias(v) for v in VALUES]),
        ),
    )
    return owned.select(F.inline(given)).groupBy("key").agg(*[F.sum(v).alias(v) for v in VALUES])


def trie(turns: DataFrame, conversations: DataFrame, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the prefix trie of ``turns`` (conv_id, i, digest, bytes) and ``conversations`` (conv_id, size).

    Nodes: key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes that members after the first share, over the subtree). Ends:
    (key, conv_id), the node at which each conversation ends. Conversations that are alike in
    all turns end at one node; those without turns at the root. Without any conversation there
    are no nodes.
    """
    longest = conversations.agg(F.max("size")).first()[0] or 0
    bands = stored(paths(turns, longest, band), "paths")
    each = F.transform(
        "keys",
        lambda key, k: F.struct(
            (F.col("band") * band + k + 1).alias("depth"),
            key.alias("key"),
            F.when(k == 0, F.col("above")).otherwise(F.get("keys", k - 1)).alias("parent"),
            F.get("bytes", k).alias("bytes"),
        ),
    )
    passed = bands.select("conv_id", F.inline(each))
    # A node's depth, parent and last text follow from its key; as grouping columns they keep the buffers of fixed width.
    nodes = passed.groupBy("key", "depth", "parent", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = stored(nodes, "valued")
    totals = rolled(bands, nodes, longest, band)
    every = nodes.drop(*VALUES).join(totals, "key")
    least = conversations.agg(F.min("conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = every.where("depth > 1").join(parents, "parent")
    outer = every.where("depth = 1").withColumn("parent_conv_id", least.scalar())
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *VALUES]
    sums = nodes.agg(*[F.sum(v).alias(v) for v in VALUES], F.sum((F.col("depth") == 1).cast("long")).alias("n_children"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root_key().alias("key"),
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.coalesce(sums.select("n_children").scalar(), F.lit(0)).alias("n_children"),
        F.coalesce(sums.select("n_leaves").scalar(), F.lit(1)).alias("n_leaves"),
        F.coalesce(sums.select("saved_tokens").scalar(), F.lit(0)).alias("saved_tokens"),
    )
    found = inner.select(columns).unionAll(outer.select(columns)).unionAll(root)
    last = conversations.where("size > 0").select("conv_id", _band(F.col("size"), band).alias("band"))
    ends = bands.join(last, ["conv_id", "band"]).select(F.element_at("keys", -1).alias("key"), "conv_id")
    return found, ends.unionAll(conversations.where("size = 0").select(root_key().alias("key"), "conv_id"))


def _digests(batches):
    """(key, ends_sha256) of rows (key, conv_id) sorted by both; one key is held, however many rows it has."""
    key = state = None
    keys, out = [], []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.column(0).to_pylist()
        ids = [str(x) for x in batch.column(1).to_pylist()]
        cuts = [0, *(i for i in range(1, n) if names[i] != names[i - 1]), n]
        for i, j in zip(cuts, cuts[1:], strict=False):
            part = ",".join(ids[i:j]).encode()
            if names[i] != key:
                if state is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = names[i], hashlib.sha256(part)
            else:
                state.update(b"," + part)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        keys, out = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ends_sha256: SHA-256 of the conv_ids that end there, ascending, comma-joined.

    A digest is a chain over its input, so the ids of one node pass through one task, as a
    stream that is never held.
    """
    digests = ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, ends_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).drop("key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt so that some share their beginnings."""
    return with_ends(*trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))))


SQL = """
WITH RECURSIVE o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, n, 4294967295 - list_reduce(list_concat([4294967295::BIGINT], bits), lambda a, b:
           CASE WHEN b >= 0 THEN CASE WHEN xor(a, b) % 2 = 1 THEN xor(xor(a, b) >> 1, 3988292384::BIGINT) ELSE xor(a, b) >> 1 END
                WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS crc
  FROM (SELECT c, count(*) AS n,
               flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda p: list_concat([ord(substr(c::VARCHAR, p, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1]::BIGINT[]))) AS bits
        FROM o GROUP BY c)
), h AS (SELECT c, c - c % 5 AS base, crc % 9 AS h FROM k),
r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, role, text FROM (
    SELECT h.c, 0 AS part, o.i, o.role, o.text FROM h JOIN o ON o.c = h.base AND o.i <= h.h
    UNION ALL SELECT h.c, 1, o.i, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.i > h.h)
), p AS (SELECT c, list({'role': role, 'text': text} ORDER BY d) AS path FROM r GROUP BY c),
q AS (
  SELECT h.c, coalesce(p.path, []) AS path FROM h LEFT JOIN p USING (c)
), m AS (
  SELECT c, d, path[1:d] AS pre, len(path) = d AS last FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM q)
), n AS (
  SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends
  FROM m GROUP BY pre, d
), v AS (
  SELECT n.*, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(pre[d].text) END AS own,
         (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.pre[1:n.d] = n.pre) AS n_children
  FROM n
)
SELECT v.conv_id, v.d::BIGINT AS depth, (SELECT u.conv_id FROM n u WHERE u.d = v.d - 1 AND u.pre = v.pre[1:v.d - 1]) AS parent_conv_id,
       v.n_convs, v.n_children,
       (SELECT count(*) FROM v w WHERE w.n_children = 0 AND w.d >= v.d AND w.pre[1:v.d] = v.pre)::BIGINT AS n_leaves,
       (SELECT sum(w.own) FROM v w WHERE w.d >= v.d AND w.pre[1:v.d] = v.pre)::BIGINT AS saved_tokens,
       sha256(v.ends) AS ends_sha256
FROM v
"""
