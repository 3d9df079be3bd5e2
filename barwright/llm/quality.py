"""Quality by positive-unlabelled learning.

Trusted positives are training documents labelled 1; all documents of the training folds,
labelled or not, are the unlabelled web text. The class prior is the share of 1 among labelled
training documents. A linear scorer over measures of style minimises the non-negative
unbiased risk: prior times the positives' loss, plus the unlabelled loss of being negative
less the positives' part of it, which is never let fall below zero (a step that would is
turned back).

Measures are taken from whole texts in tasks. The fit sees about ``POSITIVES`` positives and
``UNLABELLED`` unlabelled documents, in one task; the counts that set those shares cover all rows.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.llm import chars
from barwright.llm.common import documents, shuffled

NAME = "op4_quality"
SQL = None
#: Bounds of the training sample: documents expected of each kind.
POSITIVES = 6000
UNLABELLED = 12000
STEPS = 1500
RATE = 0.05
DECAY = 1e-4
SIGNS = string.punctuation


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def measures(texts: list[str]) -> np.ndarray:
    """A row of style measures for each text; an empty text has zeros but for its constant."""
    d = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    points = chars.points("\n".join([*texts, ""]))
    doc = np.repeat(np.arange(d), lengths + 1)
    cls = chars.classes()[points]
    size = np.maximum(lengths, 1)[:, None]
    ascii_ = points < 128
    table = np.bincount(doc[ascii_] * 128 + points[ascii_], minlength=d * 128).reshape(d, 128).astype(float)
    table[:, 10] -= 1  # the line end put behind each text
    signs = table[:, [ord(c) for c in SIGNS]] / size
    letter, blank = cls == chars.LETTER, cls == chars.BLANK
    letters = np.bincount(doc[letter], minlength=d)
    upper = np.bincount(doc[letter & (chars.lower()[points] != points)], minlength=d)
    digits = np.bincount(doc[cls == chars.NUMBER], minlength=d)
    # Words: runs without white space, each by a hash of its code points.
    start = ~blank
    start[1:] &= blank[:-1]
    at = np.flatnonzero(start)
    word_doc = doc[at]
    words = np.bincount(word_doc, minlength=d)
    n = np.maximum(words, 1)
    if len(at):
        place = np.arange(len(points)) - np.maximum.accumulate(np.where(start, np.arange(len(points)), 0))
        mix = (points.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = np.add.reduceat(np.where(blank, np.uint64(0), mix), at)
        length = np.add.reduceat((~blank).astype(np.int64), at)
        same = lambda k: np.bincount(word_doc[k:][(h[k:] == h[:-k]) & (word_doc[k:] == word_doc[:-k])], minlength=d) / n
        near = [same(k) if len(h) > k else np.zeros(d) for k in (1, 2, 3)]
        order = np.lexsort((h, word_doc))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
        distinct = np.bincount(word_doc[order][fresh], minlength=d) / n
        mean = np.bincount(word_doc, weights=length, minlength=d) / n
        # Words that are signs alone, and those that end in a sign that is no full stop or comma.
        stop = at + length - 1
        odd = (cls[stop] == chars.OTHER) & ~np.isin(points[stop], [ord(c) for c in ".,;:?\"')"])
        odd = np.bincount(word_doc[odd], minlength=d) / n
        shout = (chars.lower()[points[at]] != points[at]) & (length > 1) & (chars.lower()[points[np.minimum(at + 1, len(points) - 1)]] != points[np.minimum(at + 1, len(points) - 1)])
        shout = np.bincount(word_doc[shout], minlength=d) / n
    else:
        near, distinct, mean, odd, shout = [np.zeros(d)] * 3, np.zeros(d), np.zeros(d), np.zeros(d), np.zeros(d)
    lines = table[:, 10] / n
    part = np.column_stack([signs, upper / np.maximum(letters, 1), digits / size[:, 0], letters / size[:, 0], *near, odd, shout, lines])
    deep = np.log1p(200 * part)
    return np.column_stack([np.ones(d), deep, part[:, -8:] * 3, distinct, mean / 10, np.log1p(words) / 10])


WIDTH = 1 + len(SIGNS) + 9 + 8 + 3


def fit_weights(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Full-batch Adam on the non-negative risk with the logistic loss; scales are folded into the weights."""
    scale = np.maximum(unlabelled.std(0), 1e-3)
    shift = unlabelled.mean(0)
    scale[0], shift[0] = 1.0, 0.0
    p, u = (positive - shift) / scale, (unlabelled - shift) / scale
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -40, 40)))
    for t in range(1, STEPS + 1):
        a, b = sigmoid(p @ w), sigmoid(u @ w)
        softplus = lambda q: -np.log(np.maximum(1 - q, 1e-17))
        rest = softplus(b).mean() - prior * softplus(a).mean()
        g_rest = b @ u / len(u) - prior * (a @ p) / len(p)
        g = prior * ((a - 1) @ p) / len(p) + g_rest if rest >= 0 else -g_rest
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return np.vstack([w, scale, shift])


def fit(train: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray | None:
    """Weights, scales and shifts from training documents (doc_id, text) and labels (doc_id, quality)."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = train.select("doc_id").join(shuffled(known), "doc_id", "left").agg(
        F.count("*"), F.count("quality"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))
    ).first()
    total, labelled, good = counts
    if not total or not good or good == labelled:
        return None
    luck = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    is_p = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (luck("p") < min(1.0, positives / good))
    is_u = luck("u") < min(1.0, unlabelled / total)
    # Light keys are joined and drawn first; then the drawn texts alone are measured. The drawn
    # keys are bounded by the two parameters, whatever the corpus, and so may be broadcast.
    drawn = train.select("doc_id").join(shuffled(known), "doc_id", "left").select("doc_id", is_p.alias("p"), is_u.alias("u")).where("p or u")
    drawn = drawn.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    sample = train.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "p", "u").mapInArrow(_measured, "doc_id long, p boolean, u boolean, x array<double>").repartition(1)
    prior = good / labelled

    def work(batches):
        rows = [r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True)]
        rows.sort(key=lambda r: (r[0], r[3]))
        p = np.array([r[3] for r in rows if r[1]]).reshape(-1, WIDTH)
        u = np.array([r[3] for r in rows if r[2]]).reshape(-1, WIDTH)
        if len(p) and len(u):
            yield pa.RecordBatch.from_arrays([pa.array(fit_weights(p, u, prior).tolist())], names=["w"])

    found = sample.mapInArrow(work, "w array<double>").collect()
    return np.array([r.w for r in found]) if found else None


def _measured(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for i, j in chars.chunks(texts):
            x = pa.array(list(measures(texts[i:j])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in (0, 2, 3)], x], names=["doc_id", "p", "u", "x"])


def scored(texts: list[str], model: np.ndarray | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    w, scale, shift = model
    out = [np.clip((measures(texts[i:j]) - shift) / scale, -8, 8) @ w for i, j in chars.chunks(texts)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *out]), -40, 40)))


def model_for(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    train = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return fit(train, labels.where(~held_out(F.col("doc_id"))).select("doc_id", "quality"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Only labels of rows that are not held out are learnt; a NULL doc_id is never learnt from.
    NULL counts as empty; empty texts are scored like others. Without labels of both kinds
    nothing can be learnt and all scores are 0.5. Repeated rows score alike; an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_for(docs, labels))

    def work(batches):
        for batch in batches:
            s = scored([t or "" for t in batch.column(1).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those scored below 0.5; rows are judged where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model_for(docs, labels))
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            s = scored([t or "" for t in batch.column(at).to_pylist()], shared.value)
            yield batch.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
