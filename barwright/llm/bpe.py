"""Byte-level BPE, encoding and decoding, with pre-tokenisation on arrays instead of a pattern.

The code points of many documents stand in one array and are looked up in a class table.
Runs of one class become small functions of a state that says what the token before has
taken of this run (nothing; the blank in front of it; one or two letters of a contraction).
Composing functions is associative, so a scan by doubling gives the state before every run;
it ends as soon as all compositions are constant. States turn into token boundaries. The
slices go through a cache of merged pairs; their offsets are kept beside the ids.

The vocabulary (about 50,000 ranks) is read once on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barwright.llm import chars
from barwright.llm.common import documents

NAME = "op7_byte_bpe"
SQL = None
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Slices that a task remembers; beyond them it starts anew.
CACHE = 600_000
STATES = 4
FREE, SPACED = 0, 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) }


def scan(functions: np.ndarray, start: int = FREE) -> np.ndarray:
    """State before each step, from each step's function as a row of outcomes by state."""
    f = functions.copy()
    step = 1
    while step < len(f):
        loose = (f != f[:, :1]).any(1)
        loose[:step] = False
        at = np.flatnonzero(loose)
        if not len(at):
            break
        f[at] = np.take_along_axis(f[at], f[at - step], 1)
        step *= 2
    state = np.empty(len(f), np.uint8)
    if len(f):
        state[0] = start
        state[1:] = f[:-1, start]
    return state


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First code points of all tokens; ``starts`` are those of the documents, none of them empty."""
    n = len(points)
    cls = chars.classes()[points]
    first = np.zeros(n, bool)
    first[1:] = cls[1:] != cls[:-1]
    first[starts] = True
    a = np.flatnonzero(first)
    b = np.append(a[1:], n)
    kind = cls[a]
    ends = np.zeros(n + 1, bool)
    ends[starts] = True
    ends[n] = True
    last = ends[b]
    blank = kind == chars.BLANK
    f = np.zeros((len(a), STATES), np.uint8)
    f[blank & ~last & (points[b - 1] == 0x20)] = SPACED
    quote = np.flatnonzero((kind == chars.OTHER) & (b - a == 1) & (points[a] == 0x27) & ~last)
    quote = quote[kind[quote + 1] == chars.LETTER]
    c = points[b[quote]]
    d = points[np.minimum(b[quote] + 1, n - 1)]
    one = np.isin(c, [ord(x) for x in "stmd"])
    two = (b[quote + 1] - a[quote + 1] >= 2) & (
        ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
    )
    f[quote, FREE] = np.where(one, 2, np.where(two, 3, 0))
    state = scan(f)
    mark = np.zeros(n, bool)
    mark[a[blank | (state == FREE)]] = True
    mark[b[blank & ~last & (b - a >= 2)] - 1] = True
    taken = np.flatnonzero(~blank & (state > SPACED))
    rest = a[taken] + state[taken] - 1
    mark[rest[rest < b[taken]]] = True
    return np.flatnonzero(mark)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank merges first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: part of another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Numbers of slices seen; the ids of slice k are flat[at[k] : at[k] + size[k]]."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE):
        self.ranks, self.most = ranks, most
        self.flat, self.at, self.size = array("i"), array("q"), array("i")

    def __missing__(self, piece: str) -> int:
        ids = merged(piece.encode("utf-8", "surrogatepass"), self.ranks)
        self[piece] = number = len(self.at)
        self.at.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text, code point where each slice starts, first slice of each text); the last of each bounds the end."""
        if len(self) > self.most:
            self.clear()
            self.flat, self.at, self.size = array("i"), array("q"), array("i")
        lengths = np.array([len(t) for t in texts], np.int64)
        until = np.cumsum(lengths)
        starts = (until - lengths)[lengths > 0]
        text = "".join(texts)
        if not text:
            none = np.zeros(len(texts) + 1, np.int64)
            return np.zeros(0, np.int32), none, np.zeros(1, np.int64), none
        cut = boundaries(chars.points(text), starts)
        bounds = cut.tolist()
        bounds.append(len(text))
        numbers = np.fromiter(map(self.__getitem__, [text[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]), np.int64, len(cut))
        size = np.frombuffer(self.size, np.int32)[numbers].astype(np.int64)
        total = np.cumsum(size)
        ids = np.frombuffer(self.flat, np.int32)[
            np.repeat(np.frombuffer(self.at, np.int64)[numbers] - (total - size), size) + np.arange(total[-1])
        ]
        slices = np.append(0, np.searchsorted(cut, until))
        return ids, np.append(0, total)[slices], np.append(cut, len(text)), slices


def run(docs: DataFrame, ranks: dict[bytes, int], finish, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chars.chunks(texts):
                yield finish(encoder, ids.slice(i, j - i), texts[i:j])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, offsets): token ids of each whole text and the code points where its slices start.

    NULL and empty texts have no ids. Rows that repeat are encoded alike; an empty table gives
    no rows; columns other than doc_id and text are ignored.
    """

    def finish(encoder, doc_ids, texts):
        ids, at, cut, slices = encoder.encode(texts)
        base = np.append(0, np.cumsum([len(t) for t in texts]))[:-1]
        offsets = cut[:-1] - np.repeat(base, np.diff(slices))
        lists = lambda v, o: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_ids, lists(ids, at), lists(offsets, slices)], names=["doc_id", "ids", "offsets"])

    return run(docs, ranks, finish, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, data): the bytes that ``ids`` stand for; no ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def work(batches):
        tokens = {v: k for k, v in shared.value.items()}
        for batch in batches:
            data = [b"".join(map(tokens.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, data binary")


def digests(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, and decoded from the ids, in one pass."""
    kept = {}

    def finish(encoder, doc_ids, texts):
        if not kept:
            size = max(encoder.ranks.values()) + 1
            kept["data"], kept["text"] = [b""] * size, [str(i) for i in range(size)]
            for k, v in encoder.ranks.items():
                kept["data"][v] = k
        data, decimal = kept["data"].__getitem__, kept["text"].__getitem__
        ids, at, _, _ = encoder.encode(texts)
        ids, at = ids.tolist(), at.tolist()
        rows = [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array([len(r) for r in rows], pa.int64()),
                pa.array([sha(",".join(map(decimal, r)).encode()) for r in rows]),
                pa.array([sha(b"".join(map(data, r))) for r in rows]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return run(docs, ranks, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> dict[bytes, int]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path(VOCABULARY))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary())
