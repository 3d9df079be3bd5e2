"""Fuzzy repeated passages by collinear chaining.

Seeds are all ``K``-word shingles, so that a passage of 50 words with 10 of them edited shares
seven. Occurrences of a seed are linked each to each up to ``MANY``. Those of a hot seed are
linked to the one in the smallest document of their task, and that one to the smallest of all,
which is a link for each occurrence and never all pairs; pairs of hot seeds 16 and 32 words
apart, and those on both sides of a gap, are then linked in the same way, so that a passage of
several frequent lines is linked to a document that has them together. Seeds travel packed by
bucket, some eight bytes each, and a task compares those of one bucket at a time.

Between two documents the links are chained: both places must rise, and a link's score is its
words plus the best score before it less the cost of the gap, found by a Fenwick tree of
prefix maxima. Chains are cut where a gap is too wide, their words are fetched from both
documents and aligned (along diagonals, and by longest common subsequence in the gaps), and
their ends are extended while this keeps the wanted similarity.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.llm import chars
from barwright.llm.common import documents, freed, given_up
from barwright.llm.suffix import part_of, powers, stir

NAME = "op5_substring_dedup"
SQL = None
#: Words of a seed. n words with n/5 edited keep n - K + 1 - K n/5 of their seeds: 7 of 50 words.
K = 4
#: A seed with more occurrences is hot: they are linked to the smallest, not each to each.
MANY = 8
#: Words from one hot seed to the other of a pair.
APART = (16, 32)
#: Links of a chain at least.
LINKS = 3
#: Words of a passage at least, and the part of them that must agree.
LEAST = 50
SIMILARITY = 0.8
#: Cost of a skipped word on either side, and the widest gap inside a passage.
GAP_COST = 0.1
GAP = 12
#: Words beside a chain that the alignment may extend into. A passage whose outer words are
#: linked elsewhere is still found: were more than this linked elsewhere, they would be a passage there.
MARGIN = 64
#: Words that an extension may pass on either side, the nearest first.
SKIPS = sorted(((i, j) for i in range(4) for j in range(4) if i or j), key=lambda p: (max(p), sum(p)))
HELD = 1 << 20
#: Requests for the words of a document that one row holds.
WANTED = 1 << 12
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words(texts: list[bytes], table) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text, with the end): A-Z in lower case, runs without white space."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    data = _lower_table()[np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)]
    blank = (data == 0x20) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.astype(np.int8)])))
    a, b = edge[::2], edge[1::2]
    up, down = table if len(table[0]) > len(data) else powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((stir(data.astype(np.uint64) + np.uint64(1)) | np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = stir((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _MIX)
    return h, np.append(0, np.searchsorted(a, np.cumsum(size)))


def seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, text) of the seeds of texts with words ``h``: every K words.

    Where a shingle is said again within ``LEAST`` words, the hash also counts how many times
    it was, so that in a passage of one word or phrase repeated the nth is linked to an nth.
    """
    n = len(h) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(K):
        g = g * _FOLD + h[j : j + n]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    p = np.flatnonzero(np.arange(n) + K <= first[text + 1])
    g, text = stir(g[p]), text[p]
    order = np.argsort(g, kind="stable")
    again = np.zeros(len(p), bool)
    x, y = order[1:], order[:-1]
    again[1:] = (g[x] == g[y]) & (text[x] == text[y]) & (p[x] - p[y] < LEAST)
    at = np.arange(len(p))
    nth = at - np.maximum.accumulate(np.where(again, 0, at))
    more = order[nth > 0]
    g[more] = stir(g[more] + nth[nth > 0].astype(np.uint64) * _MIX)
    # 48 bits pack better; should two seeds ever share them, the words decide.
    return (g >> np.uint64(16)).view(np.int64), p - first[text], text


ROWS = "bucket long, n long, blob binary"
#: Seeds that a bucket should have: bounds what a task holds at once.
FULL = 1 << 19
LINK = ["doc", "at", "ref", "rat", "hot"]


def bucket_bits(texts: DataFrame) -> int:
    """Bits that name a bucket, so that one has about ``FULL`` seeds; a word has some six bytes."""
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(max(5, (size // 6 // FULL).bit_length()), 16)


def packed(*columns: np.ndarray) -> bytes:
    """Numbers of eight bytes as differences, byte by byte; those of one document leave little but zeros."""
    steps = [np.diff(c, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T for c in columns]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in steps)


def unpacked(data: np.ndarray, n: int, columns: int) -> list[np.ndarray]:
    steps = data[: 8 * n * columns].reshape(columns, 8, n)
    return [np.cumsum(np.ascontiguousarray(x.T).view(np.int64).ravel()) for x in steps]


def occurrences(texts: DataFrame, bits: int) -> DataFrame:
    """(bucket, n, blob): seeds, packed by bucket in the order of the texts; those that are many in
    their task are linked to the smallest document of the same task (bucket below 0)."""

    def work(batches):
        table, held, size = powers(1 << 20), [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for i, j in chars.chunks(data):
                s, p, t = seeds(*words(data[i:j], table))
                part = np.array([part_of(x) for x in data[i:j]], np.int64)
                held.append([s, ids[i:j][t], (p << 16) | part[t]])
                size += len(s)
                if size >= HELD:
                    yield combined(held, bits)
                    held, size = [], 0
        if held:
            yield combined(held, bits)

    return texts.mapInArrow(work, ROWS)


def sorted_places(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` in its order; equal numbers in any."""
    if len(s) >= 1 << 21:
        return np.argsort(s)
    # Few seeds share 43 bits; those that do stand together, and so are taken for one below.
    return np.sort((s >> 5 << 21).view(np.uint64) | np.arange(len(s), dtype=np.uint64)).view(np.int64) & ((1 << 21) - 1)


def combined(held, bits: int) -> pa.RecordBatch:
    s, d, at = (np.concatenate(x) for x in zip(*held, strict=True))
    # The bucket's bits and 32 more name a seed; should two ever share them, the words decide.
    name = s >> (16 - bits)
    order = sorted_places(s)
    k, many = grouped(name[order])
    # Only of seeds that are many the order of the rows counts, and only they are linked here.
    o = order[many]
    o = o[np.lexsort((at[o], d[o], name[o]))]
    first = o[grouped(name[o])[0]]
    hot = np.zeros(len(s), np.uint8)
    hot[o] = 1
    later = d[o] > d[first]
    o, first = o[later], first[later]
    stay = np.ones(len(s), bool)
    stay[o] = False
    rows = []
    back = np.lexsort((at[o], d[o]))
    o, first = o[back], first[back]
    for i in range(0, len(o), 1 << 15):
        x, y = o[i : i + (1 << 15)], first[i : i + (1 << 15)]
        # A linked row only travels on; its document spreads it over the tasks.
        rows.append((-1 - int(abs(d[x[0]]) % 4096), len(x), packed(d[x], at[x], d[y], at[y], name[x])))
    left = np.flatnonzero(stay)
    left = left[np.argsort((name[left] >> 32).astype(np.uint16), kind="stable")]
    bucket = name[left] >> 32
    edge = np.append(np.flatnonzero(np.diff(bucket, prepend=np.int64(-1))), len(left))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        x = left[i:j]
        rows.append((int(bucket[i]), j - i, packed(d[x], at[x]) + name[x].astype(np.uint32).tobytes() + hot[x].tobytes()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([pa.compress(r[2], codec="zstd", asbytes=True) for r in rows], pa.binary()),
        ],
        names=["bucket", "n", "blob"],
    )


def grouped(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of sorted seeds, the first row of its seed and whether the seed has more than ``MANY``."""
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(s)))
    return np.repeat(start, size), np.repeat(size > MANY, size)


def linked(rows: DataFrame) -> DataFrame:
    """(doc, at, ref, rat, hot): every two occurrences of a seed in different documents, the larger first.

    Of a seed with more than ``MANY``, in all or in some task, each occurrence is linked to the
    smallest only, and in ``hot`` named with its seed (ref is NULL in the smallest). A task holds one bucket; where that
    is far above ``FULL``, as seeds of every task repeat, its hot seeds are linked on the way
    and only their smallest occurrences are kept.
    """

    def row(d, at, ref, rat, hot):
        none = pa.nulls(len(d), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(at), none if ref is None else ref, none if rat is None else rat, none if hot is None else pa.array(hot)], names=LINK)

    def pairs(held, bucket, last):
        """Links of the rows held; in the end those that stay, unless they are the last of the bucket."""
        s, d, at, hot = (np.concatenate(x) for x in zip(*held, strict=True))
        key = np.sort((s.astype(np.uint64) << np.uint64(32)) | np.arange(len(s), dtype=np.uint64))
        s, i = (key >> np.uint64(32)).view(np.int64), (key & np.uint64(0xFFFFFFFF)).view(np.int64)
        alone = np.append(True, s[1:] != s[:-1])
        alone = alone & np.append(alone[1:], True)
        single = i[alone & (hot[i] == 0)] if not last else i[:0]
        alone &= hot[i] == 0
        s, i = s[~alone], i[~alone]
        own = (key[alone] >> np.uint64(32)).view(np.int64) if not last else s[:0]
        spare = [own, d[single], at[single], hot[single]]
        d, at, hot = d[i], at[i], hot[i]
        order = np.lexsort((at, d, s))
        s, d, at, hot = s[order], d[order], at[order], hot[order]
        k, many = grouped(s)
        if len(s):
            start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            many |= np.repeat(np.maximum.reduceat(hot, start) == 2, np.diff(np.append(start, len(s))))
        name = (np.int64(bucket) << 32) | s
        m = many if last else many & ((d > d[k]) | (np.arange(len(k)) > k))
        if m.any():
            same = d[m] <= d[k[m]]
            yield row(d[m], at[m], pa.array(d[k[m]], mask=same), pa.array(at[k[m]], mask=same), name[m])
        if not last:
            stay = ~many | (np.arange(len(k)) == k)
            hot[many] = 2
            yield [np.concatenate(x) for x in zip(spare, [s[stay], d[stay], at[stay], hot[stay]], strict=True)]
            return
        # Many in some task, few here.
        m = ~many
        if len(s):
            m &= np.repeat(np.maximum.reduceat(hot, start) > 0, np.diff(np.append(start, len(s))))
        if m.any():
            yield row(d[m], at[m], None, None, name[m])
        for lag in range(1, MANY):
            near = k[lag:] == k[: len(k) - lag]
            if not near.any():
                break
            out = np.flatnonzero(near & ~many[lag:] & (d[lag:] > d[: len(d) - lag]))
            if len(out):
                yield row(d[out + lag], at[out + lag], pa.array(d[out]), pa.array(at[out]), None)

    def work(batches):
        held, size, full, seen = [], 0, 8 * FULL, None
        for batch in batches:
            for bucket, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                linked_ = bucket < 0
                data = np.frombuffer(pa.decompress(blob.as_buffer(), n * (40 if linked_ else 21), codec="zstd"), np.uint8)
                if linked_:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpacked(data, n, 5)], names=LINK)
                    continue
                if bucket != seen and held:
                    yield from pairs(held, seen, True)
                    held, size, full = [], 0, 8 * FULL
                seen = bucket
                held.append([data[16 * n : 20 * n].view(np.uint32).astype(np.int64), *unpacked(data, n, 2), data[20 * n :]])
                size += n
                if size > full:
                    *out, stay = pairs(held, seen, False)
                    yield from out
                    held, size = [stay], len(stay[0])
                    full = max(full, 2 * size)
        if held:
            yield from pairs(held, seen, True)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "doc long, at long, ref long, rat long, hot long")


def apart(links: DataFrame, bits: int) -> DataFrame:
    """Rows like ``occurrences`` of pairs of hot seeds that stand ``APART`` words from each other, or on
    both sides of a gap between hot seeds, however wide up to ``GAP`` words.

    Lines that are frequent alone are linked to documents that have them alone; what is said
    with both is linked by the pairs that reach across.
    """
    lists = links.where("hot is not null").groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("hot").alias("hot"))

    def work(batches):
        held, size = [], 0
        for batch in batches:
            cut = batch.column(1).offsets.to_numpy()
            cut = cut - cut[0]
            ats, hots = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            for n, doc in enumerate(batch.column(0).to_pylist()):
                at, hot = ats[cut[n] : cut[n + 1]], hots[cut[n] : cut[n + 1]].view(np.uint64)
                # By text and word; texts under one doc_id are told apart by their parts.
                place = ((at & 65535) << 40) | (at >> 16)
                order = np.argsort(place)
                place, at, hot = place[order], at[order], hot[order]
                for far in APART:
                    to = np.searchsorted(place, place + far)
                    i = np.flatnonzero(place[np.minimum(to, len(place) - 1)] == place + far)
                    key = stir(hot[i] * _FOLD + hot[to[i]] + np.uint64(far))
                    held.append([(key >> np.uint64(16)).view(np.int64), np.full(len(i), doc, np.int64), at[i]])
                    size += len(i)
                for key, i in across(place, hot):
                    held.append([key, np.full(len(i), doc, np.int64), at[i]])
                    size += len(i)
                if size >= HELD:
                    yield combined(held, bits)
                    held, size = [], 0
        if held:
            yield combined(held, bits)

    return lists.mapInArrow(work, ROWS)


def across(place: np.ndarray, hot: np.ndarray):
    """(seed, row) of the two hot seeds on each side of a gap, named by both next to it: the same
    in every document, however many words the gap has."""
    i = np.flatnonzero((np.diff(place) > 1) & (np.diff(place) <= K + GAP))
    key = stir(hot[i] * _FOLD + hot[i + 1] * _MIX)
    for n, step in enumerate((0, 1, -1, 2)):
        to = np.clip(i + step, 0, len(place) - 1)
        # The outer two are in the line of the inner ones.
        m = place[to] == np.where(step > 0, place[i + 1] + step - 1, place[i] + step)
        yield (stir(key[m] + np.uint64(n)) >> np.uint64(16)).view(np.int64), to[m]


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of links (x, y), sorted by x and then by falling y; each link is in one chain.

    The score of a chain that ends in a link is K words, plus the best before it less
    ``GAP_COST`` for each word skipped on either side. As that cost is linear, the best is a
    maximum over smaller y of score plus cost so far, kept in a Fenwick tree.
    """
    rank = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(rank)
    tree = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    waiting: list[int] = []
    for i in range(len(x)):
        while waiting and x[waiting[0]] < x[i]:
            j = waiting.pop(0)
            v, r = (score[j] + GAP_COST * (x[j] + y[j]), j), rank[y[j]]
            while r <= size:
                if tree[r] < v:
                    tree[r] = v
                r += r & -r
        best, r = (-1e18, -1), rank[y[i]] - 1
        while r:
            if best < tree[r]:
                best = tree[r]
            r &= r - 1
        gain = best[0] - GAP_COST * (x[i] + y[i])
        score[i] = K + max(gain, 0.0)
        back[i] = best[1] if gain > 0 else -1
        waiting.append(i)
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def wanted_seeds(words: int, similarity: float) -> int:
    """Seeds that a passage of so many words keeps, as each edited word breaks up to K."""
    return max(words - K + 1 - K * int(words * (1 - similarity) + 1e-9), LINKS)


def requests(links: DataFrame, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """(owner, key, side, other, at, start, stop, xs, ys): words to fetch from both documents of each chain."""
    kind = F.when(F.col("ref").isNull(), 2).when(F.col("hot").isNotNull(), 1).otherwise(0).cast("byte").alias("kind")
    links = links.select("doc", "at", F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("rat", F.lit(0)).alias("rat"), kind)
    lists = links.groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in ("at", "ref", "rat", "kind")])
    names = ["owner", "key", "side", "other", "part", "start", "stop", "xs", "ys"]

    def work(batches):
        for batch in batches:
            rows: list[tuple] = []
            docs = batch.column(0).to_pylist()
            cut = batch.column(1).offsets.to_numpy()
            at, ref, rat, kind = (batch.column(k).flatten().to_numpy() for k in (1, 2, 3, 4))
            cut = cut - cut[0]
            for n, doc in enumerate(docs):
                own = slice(cut[n], cut[n + 1])
                rows += of_document(doc, at[own], ref[own], rat[own], kind[own], least, similarity)
            kinds = [pa.int64()] * 7 + [pa.binary()] * 2
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 5000], strict=True), kinds, strict=True)], names=names)

    return lists.mapInArrow(
        work, "owner long, key long, side long, other long, part long, start long, stop long, xs binary, ys binary"
    )


def near(x: int, y: int) -> bool:
    """Whether a gap of x and y words may lie inside a passage; on one diagonal its words decide later."""
    return max(x, y) <= GAP or x == y <= MARGIN


@functools.cache
def lengths(least: int, similarity: float) -> list[tuple[int, int]]:
    """(seeds, words) of parts of ``least`` to twice as many words; a longer one that needs no more stands for a shorter."""
    out: list[tuple[int, int]] = []
    for n in range(2 * least, least - 1, -1):
        need = wanted_seeds(n, similarity)
        if not out or need < out[-1][0]:
            out.append((need, n))
    return out


def dense(at: np.ndarray, least: int, similarity: float) -> bool:
    """Whether seeds at the words ``at``, in order, are enough for a passage.

    A passage can be cut into parts of ``least`` to twice as many words, one of which is as
    similar as the whole; so some part has the seeds that a passage of its length keeps.
    """
    for need, n in lengths(least, similarity):
        if len(at) >= need and (at[need - 1 :] - at[: len(at) - need + 1] <= n - K).any():
            return True
    return False


def of_document(doc: int, at, ref, rat, kind, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple]:
    """Requests for the chains of a document that may be passages.

    A seed that a passage shares with the smaller document is linked to it unless it is hot
    (``kind`` above 0). So a chain with too few words, in all that the alignment would see, that are
    linked to that document or hot cannot become a passage.
    """
    keeps = wanted_seeds(least, similarity)
    hot_at = np.unique(((at & 65535) << 40 | at >> 16)[kind > 0])
    at, ref, rat = (v[kind < 2] for v in (at, ref, rat))
    out = []
    # Texts under one doc_id are told apart by their parts.
    part, rpart, x, y = at & 65535, rat & 65535, at >> 16, rat >> 16
    order = np.lexsort((-y, x, rpart, ref, part))
    part, ref, rpart, x, y = (v[order] for v in (part, ref, rpart, x, y))
    same = np.zeros(len(x), bool)  # linked alone and in a pair
    same[1:] = (part[1:] == part[:-1]) & (ref[1:] == ref[:-1]) & (rpart[1:] == rpart[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    part, ref, rpart, x, y = (v[~same] for v in (part, ref, rpart, x, y))
    new = np.flatnonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (part[1:] != part[:-1]) | (rpart[1:] != rpart[:-1])]))
    for i, j in zip(new, [*new[1:], len(x)], strict=True):
        if j - i < LINKS:
            continue
        xs, ys = x[i:j].tolist(), y[i:j].tolist()

        def beside(first, last, own=x[i:j], text=int(part[i]) << 40):
            low, high = first - MARGIN, last + K + MARGIN
            hot = hot_at[np.searchsorted(hot_at, text + max(low, 0)) : np.searchsorted(hot_at, text + high, "right")] - text
            return np.unique(np.append(hot, own[np.searchsorted(own, low) : np.searchsorted(own, high, "right")]))

        dx, dy = np.diff(x[i:j]), np.diff(y[i:j])
        # Where each link follows the one before and is worth its gap, all are one chain.
        for chain in [list(range(len(xs)))] if (dx > 0).all() and (dy > 0).all() and ((dx + dy) * GAP_COST < K).all() else chains(xs, ys):
            piece = [chain[0]]
            for c in [*chain[1:], None]:
                if c is not None and near(xs[c] - xs[piece[-1]] - K, ys[c] - ys[piece[-1]] - K):
                    piece.append(c)
                    continue
                if len(piece) >= LINKS and (len(piece) >= 2 * keeps or dense(beside(xs[piece[0]], xs[piece[-1]]), least, similarity)):
                    px, py = [xs[k] for k in piece], [ys[k] for k in piece]
                    key = struct.unpack("<q", hashlib.blake2b(struct.pack("<8q", doc, int(ref[i]), int(part[i]), int(rpart[i]), px[0], py[0], px[-1], py[-1]), digest_size=8).digest())[0]
                    out.append((doc, key, 0, int(ref[i]), int(part[i]), max(px[0] - MARGIN, 0), px[-1] + K + MARGIN, np.array(px).tobytes(), np.array(py).tobytes()))
                    out.append((int(ref[i]), key, 1, doc, int(rpart[i]), max(py[0] - MARGIN, 0), py[-1] + K + MARGIN, None, None))
                piece = [c]
    return out


def fetched(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, side, owner, other, start, words, xs, ys): the hashes of the words asked for."""
    # A document that many others refer to is read by several tasks.
    parts = asked.groupBy("owner").count().where(F.col("count") > WANTED).select("owner", F.ceil(F.col("count") / WANTED).alias("n"))
    share = F.pmod(F.xxhash64("key"), F.coalesce("n", F.lit(1)))
    lists = asked.join(parts, "owner", "left").groupBy("owner", share.alias("share")).agg(F.collect_list(F.struct("key", "side", "other", "part", "start", "stop", "xs", "ys")).alias("asked"))
    joined = texts.join(lists, texts.doc_id == lists.owner).select("owner", "text", "asked")
    names = ["key", "side", "owner", "other", "start", "words", "xs", "ys"]
    kinds = [pa.int64()] * 5 + [pa.binary()] * 3

    def work(batches):
        table = powers(1 << 20)
        for batch in batches:
            rows, size = [], 0
            for n in range(batch.num_rows):
                data = (batch.column(1)[n].as_py() or "").encode("utf-8", "surrogatepass")
                own = part_of(data)
                h = words([data], table)[0].astype(np.uint32)
                for r in batch.column(2)[n].as_py():
                    if r["part"] == own:
                        w = h[r["start"] : r["stop"]].tobytes()
                        rows.append((r["key"], r["side"], batch.column(0)[n].as_py(), r["other"], r["start"], w, r["xs"], r["ys"]))
                        size += len(w)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(
        work, "key long, side long, owner long, other long, start long, words binary, xs binary, ys binary"
    )


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short gaps."""
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        new = np.maximum(row[1:], row[:-1] + (b == v))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def extension(same: np.ndarray, similarity: float) -> int:
    """How many words beyond an end keep the score of ``similarity`` from falling for good."""
    if not len(same):
        return 0
    total = np.cumsum(np.where(same, 1.0, -similarity / (1 - similarity) if similarity < 1 else -np.inf))
    best = len(total) - 1 - int(total[::-1].argmax())
    return best + 1 if total[best] > 0 else 0


def parts(a, a0: int, b, b0: int, xs: list[int], ys: list[int], similarity: float):
    """A chain cut where a wide gap on one diagonal holds too few equal words."""
    cut = 0
    for i in range(1, len(xs)):
        px, py, x, y = xs[i - 1] + K - a0, ys[i - 1] + K - b0, xs[i] - a0, ys[i] - b0
        if x - px > GAP and (a[px:x] == b[py:y]).mean() < similarity:
            yield xs[cut:i], ys[cut:i]
            cut = i
    yield xs[cut:], ys[cut:]


def aligned(a, a0: int, b, b0: int, xs: list[int], ys: list[int], similarity: float):
    """(first, end, first of the other, end of the other, equal words) of an aligned chain, in up to several ways; places count in whole documents."""
    x, y = np.array(xs, np.int64) - a0, np.array(ys, np.int64) - b0
    turn = np.flatnonzero(np.diff(x - y)) + 1
    equal, px, py = 0, int(x[0]), int(y[0])
    for i, j in zip([0, *turn.tolist()], [*turn.tolist(), len(x)], strict=True):
        sx, sy = int(x[i]), int(y[i])
        if sx < px or sy < py:  # overlaps what is aligned already
            move = max(px - sx, py - sy)
            sx, sy = sx + move, sy + move
        ex, ey = int(x[j - 1]) + K, int(y[j - 1]) + K
        if ex <= sx:
            continue
        if sx > px and sy > py:
            equal += common(a[px:sx], b[py:sy])
        equal += int((a[sx:ex] == b[sy:ey]).sum())
        px, py = ex, ey
    fx, fy = int(x[0]), int(y[0])
    bx, by, back = reach(a[:fx][::-1], b[:fy][::-1], similarity)
    nx, ny, on = reach(a[px:], b[py:], similarity)
    yield a0 + fx - bx, a0 + px + nx, b0 + fy - by, b0 + py + ny, equal + back + on
    # An end may fall below the similarity that the whole still has.
    n = max(px - fx, py - fy)
    before, after = (np.append(0, np.cumsum(p[: min(len(p), len(q))] == q[: min(len(p), len(q))])) for p, q in ((a[:fx][::-1][:MARGIN], b[:fy][::-1][:MARGIN]), (a[px:][:MARGIN], b[py:][:MARGIN])))
    i, j = np.arange(len(before))[:, None], np.arange(len(after))
    total = np.where(equal + before[:, None] + after >= similarity * (n + i + j) - 1e-9, i + j, -1)
    i, j = divmod(int(total.argmax()), len(after))
    if total[i, j] > 0:
        yield a0 + fx - i, a0 + px + j, b0 + fy - i, b0 + py + j, equal + int(before[i]) + int(after[j])
    for shift in sorted(set((y - x).tolist())):
        yield from straight(a, a0, b, b0, shift, x[y - x == shift], similarity)


def possible(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> bool:
    """Whether ``least`` words or more of a in a row are to ``similarity`` words that b has at all."""
    both = (a[:, None] == b).any(1) if len(a) * len(b) < 1 << 18 else np.isin(a, b)
    total = np.append(0.0, np.cumsum(both - similarity))
    return bool((np.arange(len(total)) - np.searchsorted(-np.minimum.accumulate(total), -total - 1e-9)).max() >= least)


def straight(a, a0: int, b, b0: int, shift: int, x: np.ndarray, similarity: float):
    """The longest run of a diagonal, with a seed of the chain, of which ``similarity`` agree."""
    first = max(0, -shift)
    n = min(len(a), len(b) - shift) - first
    same = a[first : first + n] == b[first + shift : first + shift + n]
    total = np.append(0.0, np.cumsum(same - similarity))
    low = np.minimum.accumulate(total)
    # The smallest start from which the sum up to each end does not fall.
    start = np.searchsorted(-low, -total - 1e-9)
    size = np.arange(n + 1) - start
    inside = np.searchsorted(x, start + first) < np.searchsorted(x, np.arange(n + 1) + first - K, side="right")
    size[~inside] = 0
    j = int(size.argmax())
    if size[j] > 0:
        i = int(start[j])
        yield a0 + first + i, a0 + first + j, b0 + first + shift + i, b0 + first + shift + j, int(same[i:j].sum())


def reach(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """(words of a, words of b, equal words) by which an end may be extended: along the diagonal,
    and past a few words on either side where the next K agree."""
    x = y = equal = 0
    while True:
        n = min(len(a) - x, len(b) - y)
        more = extension(a[x : x + n] == b[y : y + n], similarity)
        equal += int((a[x : x + more] == b[y : y + more]).sum())
        x, y = x + more, y + more
        for i, j in SKIPS:
            if min(len(a) - x - i, len(b) - y - j) >= K and (a[x + i : x + i + K] == b[y + j : y + j + K]).all():
                x, y = x + i, y + j
                break
        else:
            return x, y, equal


def passages(docs: DataFrame, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, ref_doc_id, start_word, end_word, ref_start, ref_end, n_words, similarity) of fuzzy passages.

    A passage of ``least`` words or more in both documents, of which ``similarity`` agree in
    order, that also stands in a document with a smaller doc_id (``ref_doc_id``, the smallest
    of those that its seeds are linked to); ends are exclusive. Every document of a shared passage but the smallest is in a row as doc_id, and
    all are reached through ref_doc_id. Passages within one document do not count, so rows
    that repeat a doc_id are never compared with each other. NULL and short texts have no
    passages; rows without doc_id are left out, as they could not be named; an empty table
    gives no rows; other columns are ignored.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    bits = bucket_bits(texts)
    links = freed(linked(occurrences(texts, bits)), "passage-links")
    pairs = freed(linked(apart(links, bits)), "passage-pairs")
    asked = freed(requests(links.unionAll(pairs), least, similarity), "passage-chains")
    given_up(links)
    given_up(pairs)
    slices = fetched(asked, texts).repartition("key").sortWithinPartitions("key", "side")
    names = ["doc_id", "ref_doc_id", "start_word", "end_word", "ref_start", "ref_end", "n_words", "similarity"]

    def work(batches):
        mine = None
        for batch in batches:
            rows = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[1] == 0:
                    mine = r
                elif mine is not None and mine[0] == r[0]:
                    a, b = np.frombuffer(mine[5], np.uint32), np.frombuffer(r[5], np.uint32)
                    if not possible(a, b, least, similarity):
                        continue
                    xs, ys = (np.frombuffer(v, np.int64).tolist() for v in mine[6:])
                    for xs, ys in parts(a, mine[4], b, r[4], xs, ys, similarity):
                        for p, q, u, v, equal in aligned(a, mine[4], b, r[4], xs, ys, similarity):
                            part = equal / max(q - p, v - u)
                            if min(q - p, v - u) >= least and part >= similarity:
                                rows.append((mine[2], r[2], p, q, u, v, q - p, part))
                                break
            if rows:
                kinds = [pa.int64()] * 7 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = slices.mapInArrow(
        work, "doc_id long, ref_doc_id long, start_word long, end_word long, ref_start long, ref_end long, n_words long, similarity double"
    )
    return leading(freed(out.distinct(), "passages"))


def leading(rows: DataFrame) -> DataFrame:
    """``rows`` without those that say nothing new: another row of the document holds all their
    words with a smaller ref_doc_id, and their ref_doc_id itself has a row with that one there."""
    names = rows.columns
    lists = rows.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word", "ref_doc_id", "ref_start", "ref_end")).alias("each"))

    def work(batches):
        for batch in batches:
            out = []
            for doc, each in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                each = sorted((r["start_word"], -r["end_word"], r["ref_doc_id"], r["ref_start"], r["ref_end"]) for r in each)
                open_: list[tuple[int, int]] = []
                for a, b, ref, x, y in each:
                    open_ = [o for o in open_ if o[0] > a]
                    out += [(doc, ref, a, -b, x, y, low) for low in {r for e, r in open_ if e >= -b and r < ref}]
                    open_.append((-b, ref))
                # Of equal places the order above is that of ref_doc_id.
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[*names[:6], "low"])

    held = lists.mapInArrow(work, ", ".join(f"{n} long" for n in [*names[:6], "low"]))
    other = rows.select(F.col("doc_id").alias("d"), F.col("ref_doc_id").alias("r"), F.col("start_word").alias("p"), F.col("end_word").alias("q"))
    known = held.join(other, (held.ref_doc_id == other.d) & (held.low == other.r) & (other.p < held.ref_end) & (other.q > held.ref_start), "left_semi")
    return rows.join(known.select(names[:6]).distinct(), names[:6], "left_anti").select(names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir))
