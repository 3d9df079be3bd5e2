"""Exact repeated substrings of documents by an enhanced suffix array in buckets.

Suffixes that share their first bytes stand together in a suffix array, so the array of a
corpus can be built in buckets. Here a bucket is named by a seed: of the ``SEED``-byte strings
in each string of ``LEAST`` bytes the one of smallest hash, which equal strings choose alike.
Neighbouring strings with one seed form a segment of less than 2 x ``LEAST`` bytes.

1. Equal segments are one text of the array with many occurrences. Only hashes move: of an
   occurrence in another document of the same task no row is needed elsewhere (it is decided
   on the spot), so a passage in a third of all documents sends a row per task, not per document.
2. Seeds with several different segments become buckets. Their bytes are fetched once for
   each different segment, and reduced to what no smaller document of the same task holds.
3. In a bucket the suffixes are sorted, common prefixes measured, and the tree of
   common-prefix intervals walked with a stack. An interval of ``LEAST`` bytes or more whose
   suffixes are preceded by different bytes is a maximal repeat; it is given with all its
   occurrences.

4. A bucket of many different segments (a short line that unique text surrounds) is not sorted in
   one task: each of its strings of ``LEAST`` bytes goes by its own hash, and all but those of the
   smallest document are removed, which is the same result.

A byte goes if an occurrence covers it and a document with a smaller doc_id has another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.llm import chars
from barwright.llm.common import documents, stored

NAME = "op6_suffix_dedup"
SQL = None
LEAST = 50
SEED = 16
# Segments or bytes that a task holds before it decides what it can: bounds memory.
HELD = 1 << 20
BYTES = 1 << 20
#: Different segments that a bucket may have; the strings of larger ones are dealt by their own hashes.
SPLIT = 1 << 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, seed: int, table):
    """(seed, hash, first byte, length, document) of the segments of documents in ``data``.

    A string of ``least`` bytes belongs to the segment of the seed it chooses: the smallest
    hash, the leftmost of equals.
    """
    up, down = table
    n = len(data)
    windows = n - least + 1
    if windows <= 0:
        return [np.zeros(0, np.int64)] * 5
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((stir(data.astype(np.uint64) + np.uint64(1)) | np.uint64(1)) * up[:n], out=sums[1:])

    def hashed(a, b):
        return stir((sums[b] - sums[a]) * down[a])

    grams = stir((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
    # Hash above, place below: the minimum is the smallest hash, then the leftmost.
    low = ((grams >> np.uint64(24)) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    width, span = least - seed + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = np.arange(len(low))
    pick = at + (((low & np.uint64((1 << 24) - 1)).astype(np.int64) - at) & ((1 << 24) - 1))
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.arange(windows) + least <= ends[doc[:windows]]
    first = inside.copy()
    first[1:] &= (pick[1:] != pick[:-1]) | (doc[1:windows] != doc[: windows - 1])
    a = np.flatnonzero(first)
    d = doc[a]
    # A segment's last string: the one before the next segment, or the document's last.
    b = np.append(a[1:] - 1, windows - 1)
    b = np.minimum(b, ends[d] - least) + least
    place = (pick[a] - a).astype(np.uint64)
    whole = stir(hashed(a, b) + place * _BASE + (b - a).astype(np.uint64) * _MIX)
    return grams[pick[a]].astype(np.uint32).view(np.int32).astype(np.int64), whole.view(np.int64), a - starts[d], b - a, d


def pack(start: np.ndarray, length: np.ndarray, part: np.ndarray) -> np.ndarray:
    """First byte, length and 16 bits that tell texts under one doc_id apart, in one number."""
    return (start.astype(np.int64) << 24) | (length.astype(np.int64) << 16) | part.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 16) & 255, at & 65535


def part_of(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=2).digest(), "little")


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    return chars.chunks(texts)


def marked(docs: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, hash, doc, at, known): every segment; known where a smaller document of the same task has it too."""

    def work(batches):
        table = powers(1 << 20)
        held: list[list[np.ndarray]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts):
                size = np.array([len(t) for t in texts[i:j]], np.int64)
                ends = np.cumsum(size)
                data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
                if len(data) >= len(table[0]):
                    table = powers(len(data))
                s, h, a, n, d = segments(data, ends - size, ends, least, seed, table)
                part = np.array([part_of(t) for t in texts[i:j]])
                held.append([s, h, ids[i:j][d], pack(a, n, part[d])])
            if sum(len(x[0]) for x in held) >= HELD:
                yield from combined(held)
                held = []
        if held:
            yield from combined(held)

    return docs.select("doc_id", "text").mapInArrow(work, "seed long, hash long, doc long, at long, known boolean")


def combined(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    s, h, d, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((d, h, s))
    s, h, d, at = s[order], h[order], d[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
    first = d[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    known = d > first
    # Of repeats in the smallest document itself one row speaks for all; the others stay too, they are few.
    s = np.where(known, d, s)
    for i in range(0, len(s), 1 << 17):
        k = slice(i, i + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (s, h, d, at, known)], names=["seed", "hash", "doc", "at", "known"])


def decided(rows: DataFrame) -> DataFrame:
    """(doc, at, seed): occurrences to remove (seed NULL), and those in the smallest document of each
    different segment of a seed that has several.

    Rows come sorted by (known, seed, hash, doc); a group of any size passes through, and only
    the places in one document are held.
    """

    def work(batches):
        seed = hash_ = first = None
        open_ = [[], []]  # (doc, at) of the last different segment in its smallest document
        several = False  # whether its seed has had another
        for batch in batches:
            s, h, d, at = (batch.column(k).to_numpy() for k in range(4))
            known = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            gone_d, gone_at = [d[known]], [at[known]]
            s, h, d, at = s[~known], h[~known], d[~known], at[~known]
            if len(s):
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
                new[0] = s[0] != seed or h[0] != hash_
                k = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
                low = np.where(k >= 0, d[np.maximum(k, 0)], 0 if first is None else first)
                gone_d.append(d[d > low])
                gone_at.append(at[d > low])
                # Groups: 0 is the one still open, then those that begin here.
                group = np.cumsum(new)
                name = np.append(0 if seed is None else seed, s[new])
                more = np.zeros(len(name), bool)
                same = name[1:] == name[:-1]
                if seed is None and len(same):
                    same[0] = False
                more[1:] |= same
                more[:-1] |= same
                more[0] |= several
                stay = d == low
                own_d = np.concatenate([np.array(open_[0], np.int64), d[stay]])
                own_at = np.concatenate([np.array(open_[1], np.int64), at[stay]])
                own = np.concatenate([np.zeros(len(open_[0]), np.int64), group[stay]])
                last = group[-1]
                out = more[own] & (own < last)
                if out.any():
                    yield given(own_d[out], own_at[out], name[own[out]])
                open_ = [own_d[own == last], own_at[own == last]]
                several = bool(more[last])
                seed, hash_, first = s[-1], h[-1], low[-1]
            yield given(np.concatenate(gone_d), np.concatenate(gone_at), None)
        if several and len(open_[0]):
            yield given(open_[0], open_[1], np.full(len(open_[0]), seed))

    ordered = rows.repartition("seed").sortWithinPartitions("known", "seed", "hash", "doc")
    return ordered.mapInArrow(work, "doc long, at long, seed long")


def given(doc, at, seed) -> pa.RecordBatch:
    seed = pa.nulls(len(doc), pa.int64()) if seed is None else pa.array(seed)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), seed], names=["doc", "at", "seed"])


def intervals(prefix: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats in a suffix array.

    ``prefix[i]`` is the common prefix of suffixes i - 1 and i (0 first), ``left[i]`` the byte
    before suffix i, or a number of its own where there is none. The tree of common-prefix
    intervals is walked with a stack of [length, first suffix, byte before all of them or None].
    """
    stack: list[list] = []
    for i in range(1, len(prefix) + 1):
        length = prefix[i] if i < len(prefix) else 0
        start, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > length:
            n, start, byte = stack.pop()
            byte = byte if byte == before else None
            if byte is None:
                yield n, start, i - 1
            before = byte
        if length >= least:
            if stack and stack[-1][0] == length:
                if stack[-1][2] != before:
                    stack[-1][2] = None
            else:
                stack.append([length, start, before])
        elif stack:
            raise AssertionError("an open interval is longer than the shared prefix")


def strings(data: np.ndarray, least: int) -> np.ndarray:
    """A hash of the ``least`` bytes from each place on."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((stir(data.astype(np.uint64)) | np.uint64(1)) * up[:-1], out=sums[1:])
    return (sums[least:] - sums[:-least]) * down[: len(data) - least + 1]


def suffix_array(pieces: list[bytes], least: int):
    """(piece, place in it, common prefix, byte before) of the sorted suffixes that begin with a string of
    ``least`` bytes that another begins with too; the others share too little to be in any interval.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    most = int(size.max())
    # One is added to each byte, so that the zeros that fill up a suffix come before all bytes.
    data = np.frombuffer(b"".join(pieces) + bytes(most), np.uint8) + np.uint8(1)
    begin = np.cumsum(size) - size
    each = np.maximum(size - least + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), each)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(each) - each, each)
    h = strings(data, least)[begin[piece] + place]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    several = np.zeros(len(h), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    piece, place = piece[several], place[several]
    rest = size[piece] - place
    where = (begin[piece] + place)[:, None] + np.arange(most)
    table = data[where]
    table[np.arange(most) >= rest[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(table).view(f"S{most}").ravel(), kind="stable")
    table, piece, place, rest = table[order], piece[order], place[order], rest[order]
    differ = table[1:] != table[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), most)
    prefix = np.append(0, np.minimum(prefix, np.minimum(rest[1:], rest[:-1]))) if len(rest) else np.zeros(0, np.int64)
    before = np.where(place > 0, data[np.maximum(begin[piece] + place - 1, 0)].astype(np.int64), -1 - np.arange(len(place)))
    return piece, place, prefix, before


def repeats(pieces: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, pieces, places) of every maximal repeat of ``pieces``, with all its occurrences."""
    if not pieces or max(map(len, pieces)) < least:
        return
    piece, place, prefix, before = suffix_array(pieces, least)
    # The walk takes one run of neighbours that share enough at a time; most suffixes share nothing.
    shared = prefix >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], shared, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        a -= 1
        own = prefix[a:b].copy()
        own[0] = 0
        for n, i, j in intervals(own.tolist(), before[a:b].tolist(), least):
            yield n, piece[a + i : a + j + 1], place[a + i : a + j + 1]


def covered(pieces: list[bytes], doc: np.ndarray, least: int) -> np.ndarray:
    """For each byte of the joined pieces, whether the string of ``least`` bytes that starts there is in a smaller document."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    hit = np.zeros(int(size.sum()) + 1, np.int64)
    for n, piece, place in repeats(pieces, least):
        d = doc[piece]
        later = d > d.min()
        if later.any():
            a = begin[piece[later]] + place[later]
            np.add.at(hit, a, 1)
            np.add.at(hit, a + n - least + 1, -1)
    return np.cumsum(hit)[:-1] > 0


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def bucketed(pieces, doc, at, seed, least) -> tuple[tuple, tuple]:
    """Occurrences to remove (doc, first byte, end, part), and what is left as pieces (doc, at, seed, bytes)."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(pieces)), size)
    gone = covered(pieces, doc, least)
    starts = np.arange(len(owner)) - begin[owner] <= size[owner] - least
    a, _, part = unpack(at)

    def cut(flag):
        # A run ends with its piece: a piece's last strings start before its last bytes.
        x, y = runs(flag & starts)
        return owner[x], x - begin[owner[x]], y - begin[owner[x]] + least - 1

    o, x, y = cut(gone)
    removed = (doc[o], a[o] + x, a[o] + y, part[o])
    o, x, y = cut(~gone)
    left = (doc[o], pack(a[o] + x, y - x, part[o]), seed[o], [pieces[p][i:j] for p, i, j in zip(o.tolist(), x.tolist(), y.tolist(), strict=True)])
    return removed, left


def dealt(asked: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(seed, doc, at, piece, a, b, part): the bytes ``piece`` of the segments ``asked`` (doc, at, seed);
    or, in buckets of more than ``SPLIT`` segments, the place ``a`` of each string under its hash ``seed``;
    or, with ``b``, bytes [a, b) to remove."""
    # Seeds are few bits of a hash, so strings and buckets are told apart by what they have, not by the key.
    large = asked.groupBy("seed").count().where(F.col("count") > SPLIT).select("seed", F.lit(True).alias("large"))
    asked = asked.join(large, "seed", "left").select("doc", "at", "seed", F.coalesce("large", F.lit(False)).alias("large"))
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("at", "seed", "large")).alias("wanted"))
    joined = texts.join(lists, texts.doc_id == lists.doc).select("doc", "text", "wanted")
    names = ["seed", "doc", "at", "piece", "a", "b", "part"]

    def rows(removed, left, large):
        d, a, b, part = removed
        none = pa.nulls(len(d), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(d), none, pa.nulls(len(d), pa.binary()), pa.array(a), pa.array(b), pa.array(part)], names=names)
        d, at, seed, piece = left
        split = np.isin(seed, large)
        whole = [p for p, x in zip(piece, split.tolist(), strict=True) if not x]
        none = pa.nulls(len(whole), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(seed[~split]), pa.array(d[~split]), pa.array(at[~split]), pa.array(whole, pa.binary()), none, none, none], names=names)
        if split.any():
            own = [p for p, x in zip(piece, split.tolist(), strict=True) if x]
            size = np.array([len(p) for p in own], np.int64)
            o = np.repeat(np.arange(len(own)), size - least + 1)
            i = np.arange(len(o)) - np.repeat(np.cumsum(size - least + 1) - (size - least + 1), size - least + 1)
            h = stir(strings(np.frombuffer(b"".join(own), np.uint8), least)[(np.cumsum(size) - size)[o] + i]).view(np.int64)
            first, _, part = unpack(at[split])
            d = d[split]
            for k in range(0, len(o), 1 << 17):
                c = slice(k, k + (1 << 17))
                none = pa.nulls(len(o[c]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(h[c]), pa.array(d[o[c]]), none, pa.nulls(len(o[c]), pa.binary()), pa.array(first[o[c]] + i[c]), none, pa.array(part[o[c]])], names=names)

    def fetch(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text, wanted in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                own = part_of(data)
                for w in wanted:
                    a, n, part = w["at"] >> 24, (w["at"] >> 16) & 255, w["at"] & 65535
                    if part == own:
                        held.append((data[a : a + n], doc, w["at"], w["seed"], w["large"]))
                        size += n
                if size >= BYTES:
                    yield from reduced(held)
                    held, size = [], 0
        if held:
            yield from reduced(held)

    def reduced(held):
        large = list({x[3] for x in held if x[4]})
        yield from rows(*bucketed(*columns([x[:4] for x in held]), least), large)

    return joined.mapInArrow(fetch, "seed long, doc long, at long, piece binary, a long, b long, part long")


def columns(held):
    p, d, at, s = zip(*held, strict=True)
    return list(p), np.array(d, np.int64), np.array(at, np.int64), np.array(s, np.int64)


def compared(asked: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(doc, a, b, part): bytes [a, b) to remove from the segments ``asked`` (doc, at, seed)."""

    def scan(batches):
        held, size, last = [], 0, None
        string = low = None  # the last string and its smallest document
        for batch in batches:
            whole = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            ranged = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            done = np.flatnonzero(ranged)
            if len(done):
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(done)) for k in (1, 4, 5, 6)], names=["doc", "a", "b", "part"])
            alone = np.flatnonzero(~whole & ~ranged)
            if len(alone):
                h, d, a, part = (batch.column(k).take(pa.array(alone)).to_numpy() for k in (0, 1, 4, 6))
                new = np.append(h[0] != string, h[1:] != h[:-1])
                k = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
                least_doc = np.where(k >= 0, d[np.maximum(k, 0)], 0 if low is None else low)
                string, low = h[-1], least_doc[-1]
                m = d > least_doc
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[m], a[m], a[m] + least, part[m])], names=["doc", "a", "b", "part"])
            bucket = batch.filter(pa.array(whole))
            for seed, doc, at, piece in zip(*[bucket.column(k).to_pylist() for k in range(4)], strict=True):
                if size >= BYTES and seed != last:
                    yield final(held)
                    held, size = [], 0
                held.append((piece, doc, at, seed))
                size += len(piece)
                last = seed
        if held:
            yield final(held)

    def final(held):
        d, a, b, part = bucketed(*columns(held), least)[0]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, a, b, part)], names=["doc", "a", "b", "part"])

    pieces = dealt(asked, texts, least).repartition("seed").sortWithinPartitions("seed", "doc")
    return pieces.mapInArrow(scan, "doc long, a long, b long, part long")


def repeated(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text) of rows with a doc_id, (doc, a, b, part): bytes [a, b) that a smaller document has too)."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    found = stored(decided(marked(texts, least, seed)), "suffix-segments")
    start, length, part = F.shiftright("at", 24), F.shiftright("at", 16).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(65535))
    whole = found.where("seed is null").select("doc", start.alias("a"), (start + length).alias("b"), part.alias("part"))
    return texts, whole.unionAll(compared(found.where("seed is not null"), texts, least))


def without_repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) of every row: the bytes left of its text, and the removed runs [a, b).

    A byte goes if a string of ``least`` bytes covers it that also starts in a document with a
    smaller doc_id. NULL counts as empty. Rows that repeat a doc_id are the same document, so
    they take nothing from each other. Rows without doc_id have no order and lose nothing.
    An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    texts, ranges = repeated(docs, least, seed)
    lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("a", "b", "part")).alias("spans"))
    rows = texts.join(lists, texts.doc_id == lists.doc, "left").select("doc_id", "text", "spans")
    rows = rows.unionAll(docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<a:bigint,b:bigint,part:bigint>>")))

    def work(batches):
        for batch in batches:
            size, kept, cut = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                own = part_of(data) if spans else 0
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in spans or () if x["part"] == own):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                last, parts = 0, []
                for a, b in merged:
                    parts.append(data[last:a])
                    last = b
                parts.append(data[last:])
                size.append(len(data))
                kept.append(b"".join(parts))
                cut.append([{"a": a, "b": b} for a, b in merged])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(cut, kind)], names=["doc_id", "n_bytes", "kept", "spans"]
            )

    return rows.mapInArrow(work, "doc_id long, n_bytes long, kept binary, spans array<struct<a:bigint,b:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
