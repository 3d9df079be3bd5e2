"""Phrase collocations, counted by broadcast double-array tries.

Candidates come by Apriori, level by level: a phrase can occur ``LEAST`` times only if both its
shorter parts do. Each level sums hashes of phrases over all shards of the text; hashes that
reach ``LEAST`` set bits of a bitmap of fixed size, and the next level hashes only phrases
whose two parts have their bits set. Hashes that collide or bits that are shared add
candidates and never lose one. The phrases behind the hashes that remain are then counted
exactly: dealt to tries whose keys hold about ``TRIE_BYTES`` bytes together, each broadcast on
its own as a double array. A task advances the states of all word starts of its text at the
same time, one byte a step; the states that accept are counted by ``bincount``, and the counts
of all shards are summed.

What is broadcast is bounded: a bitmap has ``1 << BITS`` bits, a trie at most as many states as
its keys have bytes. More candidates make more tries, each one more reading of the text. Texts
are worked through in blocks of about ``BLOCK`` bytes that overlap by two words, so that very
long texts need no more memory than short ones beyond the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barwright.llm.common import documents, stored

NAME = "op13_collocations"
LEAST = 10
LONGEST = 3
FIRST = 2000
#: Share of a phrase, in hundredths, that a longer candidate must hold to drop it.
COVER = 50
#: Bits of a level's bitmap, as a power of two.
BITS = 26
#: Bytes of the keys of one trie.
TRIE_BYTES = 8 << 20
BLOCK = 1 << 20
#: Distinct hashes that a task holds before it hands them on.
HELD = 1 << 21
#: Rows of one batch that a task hands on.
ROWS = 1 << 16
#: Parts of a language that are ranked by themselves before the rest is ranked together.
PARTS = 64

# What ends a piece, and what ends a word within one.
ENDS = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
WORD = "[^\\x20\\x09.,;:!?\\x0A-\\x0D]+"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its kind (0 word, 1 gap, 2 end of a piece), and its lower case."""
    kind = np.zeros(256, np.uint8)
    kind[list(GAPS)] = 1
    kind[list(ENDS)] = 2
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return kind, low


_PRIME = 0x9E3779B97F4A7C15
_POWERS = np.ones((2, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        both = np.ones((2, max(n, BLOCK + 4096)), np.uint64)
        both[0, 1:], both[1, 1:] = _PRIME, pow(_PRIME, -1, 1 << 64)
        _POWERS = np.multiply.accumulate(both, axis=1)
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of one block in lower case, each followed by one space, with their starts and ends.

    ``follow`` tells how many words follow within the piece, two at most. Only the first
    ``count`` words begin phrases here; the two behind them belong to the next block.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, follow: np.ndarray, count: int):
        self.data, self.follow, self.count = data, follow, count
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.data[self.end] = 32

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word; ``seed`` stands for the language."""
        power, inverse = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
        # The inverse takes away how far into the block a word stands.
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return _mixed(h ^ np.uint64(seed)) + (self.end - self.start).astype(np.uint64)


    def phrases(self, at: np.ndarray, level: int, h: np.ndarray, lang: str) -> pa.RecordBatch:
        """(h, lang, phrase, words) of the phrases of ``level`` words that begin at the words ``at``."""
        size = self.end[at + level - 1] - self.start[at]
        offsets = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        text = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(_spans(self.data, self.start[at], size)))
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.repeat(pa.scalar(lang, pa.string()), len(at)), text, pa.repeat(pa.scalar(level, pa.int32()), len(at))],
            names=["h", "lang", "phrase", "words"],
        )


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one behind the other; what lies behind the data is its last byte."""
    total = int(size.sum())
    at = np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)
    return data[np.minimum(at, len(data) - 1, out=at)]


def blocks(text: np.ndarray, size: int = BLOCK) -> Iterator[Words]:
    """The words of a text given as bytes, a block at a time."""
    kind, low = _tables()
    at, n = 0, len(text)
    while at < n:
        # A block reaches to the first gap after ``size`` bytes; two more words are read beyond it.
        stop, extra = at + size, 0
        ends = []
        while len(ends) < 3 and stop < n:
            window = kind[text[stop : stop + size]] > 0
            # Ends of words from here on: a gap whose left neighbour belongs to a word.
            left = np.concatenate([[kind[text[stop - 1]] > 0], window[:-1]])
            found = np.flatnonzero(window & ~left) + stop
            ends += found[: 3 - len(ends)].tolist()
            stop = ends[-1] if len(ends) == 3 else stop + size
        cut = ends[0] if ends else n
        far = ends[2] if len(ends) == 3 else n
        piece = text[at:far]
        k = kind[piece]
        word = k == 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        if word[-1]:
            edge = np.concatenate([edge, [len(piece)]])
        start, end = edge[::2], edge[1::2]
        count = int(np.searchsorted(start, cut - at))
        if count:
            # The strongest kind of byte between a word and the next one.
            gap = np.maximum.reduceat(k[: end[-1]], end[:-1]) if len(end) > 1 else k[:0]
            joined = gap < 2
            follow = np.zeros(len(start), np.int8)
            follow[:-1] += joined
            follow[:-2] += joined[:-1] & joined[1:]
            # Each word keeps one byte behind it, which becomes a space.
            keep = word.copy()
            keep[1:] |= word[:-1]
            data = low[piece[keep]]
            if word[-1]:
                data = np.append(data, np.uint8(32))
            yield Words(data, end - start, follow, count)
        at = cut


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """(language, several texts of it as bytes), texts parted by the end of a piece; about ``BLOCK`` bytes, or one text."""
    by: dict[str, list] = {}
    held: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        view = text.as_buffer()
        if view is not None and view.size:
            by.setdefault(lang, []).append(view)
            held[lang] = held.get(lang, 0) + view.size
            if held[lang] >= BLOCK:
                yield lang, np.frombuffer(b"\n".join(by.pop(lang)), np.uint8)
                held[lang] = 0
    for lang, views in by.items():
        yield lang, np.frombuffer(b"\n".join(views), np.uint8)


def _seed(lang: str) -> int:
    h = 0xCBF29CE484222325
    for b in lang.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def levels(words: Words, seed: int, bitmaps: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Level by level, hashes of the phrases that begin at each word; 0 where there is no candidate.

    ``bitmaps`` are those of the levels below: both shorter parts of a phrase must be in them.
    """
    one = words.hashes(seed)
    one[one == 0] = 1
    found = one
    yield found
    for k, below in enumerate(bitmaps, 2):
        deeper = np.zeros(len(one), np.uint64)
        if len(one) >= k:
            alive = within(below, found)
            ok = np.flatnonzero((words.follow[: 1 - k] >= k - 1) & alive[: 1 - k] & alive[1 : len(one) + 2 - k])
            deeper[ok] = _mixed(found[ok] * np.uint64(0xD6E8FEB86659FD93) + one[ok + (k - 1)]) | np.uint64(1)
        found = deeper
        yield found


def within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64((len(bitmap) * 64) - 1)
    return ((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool) & (h != 0)


def hashed(docs: DataFrame, level: int, bitmaps) -> DataFrame:
    """(h, n): hashes of the phrases of ``level`` words with the occurrences that a task has seen."""

    def work(batches):
        maps = [b.value for b in bitmaps]
        held, size = [], 0

        def together():
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            return keys[first], np.add.reduceat(counts, first)

        def out(keys, counts):
            for i in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS].view(np.int64)), pa.array(counts[i : i + ROWS])], names=["h", "n"])

        for batch in batches:
            for lang, text in _texts(batch):
                seed = _seed(lang)
                for words in blocks(text):
                    *_, h = levels(words, seed, maps)
                    h = h[: words.count]
                    keys, counts = np.unique(h[h != 0], return_counts=True)
                    if len(keys):
                        held.append((keys, counts))
                        size += len(keys)
                    if size > HELD:
                        held = [together()]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield from out(*held[0])
                            held, size = [], 0
        if held:
            yield from out(*together())

    # Tasks have combined what they can, so that another sum before the shuffle would find nothing.
    return docs.mapInArrow(work, "h long, n long").repartition("h")


def bitmap(heavy: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits of all hashes: rows of 64 bits are put together by Spark, ``1 << bits - 6`` at most."""
    place = F.col("h").bitwiseAND((1 << bits) - 1)
    rows = heavy.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    found = rows.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def sieved(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS):
    """(heavy, bitmaps): hashes (h, words) that occur ``least`` times or more, and a broadcast bitmap for each level."""
    bitmaps, heavy = [], None
    for level in range(1, longest + 1):
        sums = hashed(docs, level, bitmaps).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        sums = stored(sums.select("h", F.lit(level).alias("words")), f"heavy-{level}")
        heavy = sums if heavy is None else heavy.unionAll(sums)
        bitmaps = [*bitmaps, docs.sparkSession.sparkContext.broadcast(bitmap(sums, bits))]
    return heavy, bitmaps


def _places(words: Words, seed: int, maps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, places, hashes) of the candidates that begin in the block."""
    for level, (h, own) in enumerate(zip(levels(words, seed, maps[:-1]), maps, strict=True), 1):
        at = np.flatnonzero(within(own, h[: words.count]))
        yield level, at, h[at]


def candidates(docs: DataFrame, heavy: DataFrame, bitmaps) -> DataFrame:
    """(h, twin, lang, phrase, words): the phrases behind the hashes ``heavy``.

    By collisions of hashes a few others may be among them; ``twin`` numbers those of one hash.
    """

    def work(batches):
        maps = [b.value for b in bitmaps]
        known = np.zeros(0, np.uint64)
        rows, size = [], 0

        def out():
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches(max_chunksize=ROWS)

        for batch in batches:
            for lang, text in _texts(batch):
                seed = _seed(lang)
                for words in blocks(text):
                    for level, at, h in _places(words, seed, maps):
                        # A phrase of another length with the same hash is another candidate.
                        keys, first = np.unique(h ^ np.uint64(level), return_index=True)
                        place = np.searchsorted(known, keys)
                        new = np.ones(len(keys), bool)
                        new[place < len(known)] = known[place[place < len(known)]] != keys[place < len(known)]
                        known = np.sort(np.concatenate([known, keys[new]]), kind="stable")
                        at = at[first[new]]
                        if len(at):
                            rows.append(words.phrases(at, level, h[first[new]], lang))
                            size += len(at)
                    if size > ROWS:
                        yield from out()
                        rows, size = [], 0
                    # What was handed on may be handed on again: it is made distinct behind the shuffle.
                    if len(known) > HELD:
                        known = np.zeros(0, np.uint64)
        if rows:
            yield from out()

    found = docs.mapInArrow(work, "h long, lang string, phrase string, words int").repartition("h")
    # Bits may be shared; hashes of 64 bits leave next to nothing that is not wanted.
    found = found.distinct().join(heavy.select("h"), "h", "left_semi")
    twin = F.row_number().over(Window.partitionBy("h").orderBy("lang", "phrase"))
    return stored(found.select("h", twin.alias("twin"), "lang", "phrase", "words"), "candidates")


def double_array(flat: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, accept, at): the trie of distinct keys as a double array, and each key's state.

    Key i is ``flat[offset[i]:offset[i + 1]]``. From state s a byte b leads to base[s] + b if
    check says s there. accept has the number of the key that ends in a state, else -1. The
    root is state 0.
    """
    size = np.diff(offset)
    keys = len(size)
    # Nodes level by level: a node is a distinct (parent, byte).
    node = np.zeros(keys, np.int64)
    parents, bytes_, count, depth = [], [], 1, 0
    alive = np.flatnonzero(size > 0)
    while len(alive):
        code = node[alive] * 256 + flat[offset[alive] + depth]
        fresh, place = np.unique(code, return_inverse=True)
        parents.append((fresh // 256).astype(np.int32))
        bytes_.append((fresh % 256).astype(np.uint8))
        node[alive] = count + place
        count += len(fresh)
        depth += 1
        alive = alive[size[alive] > depth]
    parent = np.concatenate([np.zeros(0, np.int32), *parents])
    byte = np.concatenate([np.zeros(0, np.uint8), *bytes_])
    # Children of a node stand together, as codes were sorted. Nodes with many children take
    # their places first; each round all that are left try a place, and those without a clash keep it.
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    holder = parent[first]
    kids = np.diff(np.append(first, len(parent)))
    room = 2 * count + 512
    taken = np.zeros(room, bool)
    taken[0] = True
    base = np.zeros(count, np.int32)
    slot = np.zeros(count, np.int32)
    rng = np.random.default_rng(7)
    todo = np.argsort(-kids, kind="stable")
    while len(todo):
        batch = todo[: max(1, len(todo) // 4)] if kids[todo[0]] > 1 else todo
        edges = np.repeat(first[batch] - (np.cumsum(kids[batch]) - kids[batch]), kids[batch]) + np.arange(kids[batch].sum())
        owner = np.repeat(np.arange(len(batch)), kids[batch])
        tried = rng.integers(0, room - 256, len(batch))
        wanted = tried[owner] + byte[edges]
        clash = taken[wanted]
        # Of equal places the first one stays.
        _, one = np.unique(wanted, return_index=True)
        again = np.ones(len(wanted), bool)
        again[one] = False
        bad = np.zeros(len(batch), bool)
        np.logical_or.at(bad, owner[clash | again], True)
        good = ~bad[owner]
        taken[wanted[good]] = True
        slot[1 + edges[good]] = wanted[good]
        base[holder[batch[~bad]]] = tried[~bad]
        left = batch[bad]
        todo = np.concatenate([left, todo[len(batch) :]])
        if len(left) > 0.9 * len(batch):
            # Crowded: the arrays grow.
            taken = np.concatenate([taken, np.zeros(room // 2, bool)])
            room += room // 2
    bases = np.zeros(room, np.int32)
    check = np.full(room, -1, np.int32)
    accept = np.full(room, -1, np.int32)
    bases[slot] = base
    check[slot[1:]] = slot[parent]
    accept[slot[node]] = np.arange(keys)
    return bases, check, accept, slot[node]


def advance(words: Words, first: np.ndarray, level: int, root: int, trie) -> np.ndarray:
    """Numbers of the keys of ``level`` words that the trie accepts at the words ``first``."""
    base, check, accept = trie[:3]
    pos, stop = words.start[first], words.end[first + level - 1]
    state = np.full(len(first), root, np.int32)
    met = []
    while len(pos):
        to = base[state] + words.data[pos]
        pos = pos + 1
        done = pos == stop
        ok = check[to] == state
        met.append(accept[to[done & ok]])
        ok &= ~done
        state, pos, stop = to[ok], pos[ok], stop[ok]
    met = np.concatenate([np.zeros(0, np.int32), *met])
    return met[met >= 0]


def _walk(trie, key: bytes) -> int:
    """The state that ``key`` leads to from the root, or -1."""
    state = 0
    for b in key:
        to = int(trie[0][state]) + b
        if trie[1][to] != state:
            return -1
        state = to
    return state


def counted(docs: DataFrame, found: DataFrame, bitmaps, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``found`` (see :func:`candidates`) with f, the exact occurrences in all texts."""
    spark = docs.sparkSession
    size = F.octet_length("lang") + F.octet_length("phrase") + 1
    total = found.agg(F.sum(size.cast("long"))).first()[0] or 0
    tries = -(-total // trie_bytes) or 1
    every = None
    for number in range(tries):
        # The keys of one trie, about ``trie_bytes`` of them, whatever the corpus.
        # A phrase has no line end, so the last one in a key ends the language.
        key = F.concat("lang", F.lit("\n"), "phrase").alias("key")
        part = found.where(F.pmod("h", F.lit(tries)) == number).select("h", "twin", key).toArrow()
        part = part.combine_chunks()
        key = part.column("key").cast(pa.large_binary()).combine_chunks()
        _, offset, flat = key.buffers() if len(key) else (None, None, None)
        offset = np.frombuffer(offset, np.int64, len(key) + 1, 8 * key.offset) if len(key) else np.zeros(1, np.int64)
        arrays = double_array(np.frombuffer(flat, np.uint8) if flat else np.zeros(0, np.uint8), offset)[:3]
        shared = spark.sparkContext.broadcast((*arrays, part.column("h").to_numpy(), part.column("twin").to_numpy()))
        del part, key, offset, flat, arrays

        def work(batches, shared=shared, number=number):
            maps = [b.value for b in bitmaps]
            trie = shared.value
            counts = np.zeros(len(trie[3]), np.int64)
            for batch in batches:
                for lang, text in _texts(batch):
                    root, seed = _walk(trie, f"{lang}\n".encode()), _seed(lang)
                    if root >= 0:
                        for words in blocks(text):
                            for level, at, h in _places(words, seed, maps):
                                here = at if tries == 1 else at[h.view(np.int64) % tries == number]
                                counts += np.bincount(advance(words, here, level, root, trie), minlength=len(counts))
            at = np.flatnonzero(counts)
            for i in range(0, len(at), 1 << 16):
                k = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(trie[3][k]), pa.array(trie[4][k]), pa.array(counts[k])], names=["h", "twin", "f"])

        each = docs.mapInArrow(work, "h long, twin int, f long").groupBy("h", "twin").agg(F.sum("f").alias("f"))
        each = stored(each, f"counts-{number}")
        shared.unpersist()
        every = each if every is None else every.unionAll(each)
    return found.join(every, ["h", "twin"]).select("lang", "phrase", "words", "f")


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""
    return docs.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n"))


def scored(counts: DataFrame, totals: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases of two words or more.

    The score is that of the lowest cut, ties to the earliest. Products are decimals of 38
    digits, which are exact up to some 10^15 occurrences of a phrase.
    """
    counts = counts.where(F.col("f") >= least)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "w", cut)
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("p"), part(F.col("k") + 1, F.col("words")).alias("q"))
    f = counts.select("lang", "phrase", "f")
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("p"), F.col("f").alias("l")), ["lang", "p"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("q"), F.col("f").alias("r")), ["lang", "q"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000bd) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = Window.partitionBy("lang", "phrase").orderBy("score", "k")
    cuts = cuts.withColumn("best", F.row_number().over(best)).where("best = 1").drop("best")
    return cuts.join(totals, "lang").select("lang", "phrase", "words", "a", "l", "r", "n", "score")


def without_covered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """Phrases that no longer candidate holds in ``cover`` hundredths of their occurrences or more."""
    w = F.split("phrase", " ")
    inner = phrases.where("words > 2").select("lang", F.col("a").alias("longer"), "words", w.alias("w"))
    inner = inner.select("lang", "longer", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "longer", "w", "size", F.explode(F.expr("sequence(1, words - size + 1)")).alias("at"))
    inner = inner.select("lang", F.array_join(F.expr("slice(w, at, size)"), " ").alias("phrase"), "longer")
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rows = phrases.join(inner, ["lang", "phrase"], "left")
    return rows.where(f"longer is null or 100 * longer < {cover} * a").drop("longer")


def first_of_each(phrases: DataFrame, first: int = FIRST) -> DataFrame:
    """The first phrases of each language by score, then a, both descending, then phrase; ranked from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # A language may hold most phrases: parts of it are ranked first, and what they leave is bounded.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = phrases.withColumn("part", part)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return rows.drop("part")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language of ``docs`` (text, lang).

    NULL texts are empty, a NULL lang is `und`, together with those that say so. Phrases do
    not cross texts. Repeated rows count each. An empty table, and one without any phrase that
    occurs ``least`` times, gives no rows. Very long texts are read whole. Other columns are ignored.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    heavy, bitmaps = sieved(rows, least)
    counts = stored(counted(rows, candidates(rows, heavy, bitmaps), bitmaps), "counts")
    phrases = stored(scored(counts, word_totals(rows), least), "scored")
    return first_of_each(without_covered(phrases), first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), w AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), o AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM o, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE f >= 10),
s AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, x.k AS cut,
         (1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN c x ON x.lang = c.lang AND x.k < c.k AND starts_with(c.phrase, x.phrase || ' ')
         JOIN c y ON y.lang = c.lang AND y.k = c.k - x.k AND c.phrase = x.phrase || ' ' || y.phrase
  WHERE c.k > 1
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), z AS (
  SELECT b.* FROM b WHERE NOT EXISTS (
    SELECT 1 FROM b t WHERE t.lang = b.lang AND t.k > b.k AND contains(' ' || t.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * t.a >= 50 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000
"""
