"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three code points are hashed to ``DIM`` features. Document frequencies are
counted over all training documents. Weights are trained by follow-the-regularised-leader
with elastic net, in one task, on a sample of about ``PER_LANGUAGE`` training documents of
each language; part of it is held back to fit the temperature. The model (DIM numbers for
each language) is broadcast; documents are scored where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.llm import chars
from barwright.llm.common import documents

NAME = "op8_language_id"
SQL = None
DIM = 1 << 13
#: Bound of the training sample: documents expected of each language.
PER_LANGUAGE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.01
UNKNOWN = "und"
# Documents whose features are counted side by side: bounds the table of counts.
TOGETHER = 128


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each n-gram, number of the text it is of, whether each text has a letter).

    Lower case; all but letters is one blank; a blank stands before and after each text.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = chars.points(" ".join(["", *texts, ""]))
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    doc = np.append(doc, len(texts) - 1)
    letter = chars.classes()[joined] == chars.LETTER
    c = np.where(letter, chars.lower()[joined], 32).astype(np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    c, doc = c[keep], doc[keep]
    grams, of = [], []
    h = c * np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - DIM.bit_length() + 1)
    for n in range(1, 4):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        use = (doc[n - 1 :] == doc[: len(doc) - n + 1]) if n > 1 else np.ones(len(h), bool)
        mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        grams.append((mixed >> shift)[use].astype(np.int32))
        of.append(doc[: len(doc) - n + 1][use])
    return np.concatenate(grams), np.concatenate(of), has


def counted(texts: list[str]):
    """Table of counts, text by feature."""
    gram, of, has = features(texts)
    return np.bincount(of * DIM + gram, minlength=len(texts) * DIM).reshape(len(texts), DIM), has


def frequencies(train: DataFrame) -> DataFrame:
    """(feature, n): in how many of all training documents a feature occurs; feature -1 counts documents."""

    def work(batches):
        seen, total = np.zeros(DIM, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in chars.chunks(texts, documents=TOGETHER):
                counts, has = counted(texts[i:j])
                seen += (counts[has] > 0).sum(0)
                total += int(has.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["feature", "n"])

    return train.select("text").mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def sparse_rows(texts: list[str], idf: np.ndarray):
    """Per text with a letter: (place, features, values of unit length)."""
    for i, j in chars.chunks(texts, documents=TOGETHER):
        counts, has = counted(texts[i:j])
        for k in np.flatnonzero(has):
            at = np.flatnonzero(counts[k])
            x = np.log1p(counts[k, at]) * idf[at]
            yield i + int(k), at, x / max(np.sqrt(x @ x), 1e-12)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_model(rows, labels: list[int], classes: int) -> tuple[np.ndarray, float]:
    """Weights by FTRL-proximal over the rows in a fixed shuffled order, and the temperature of held-back rows."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
    order = np.random.default_rng(7).permutation(len(rows))
    back, front = order[::5], [i for k, i in enumerate(order) if k % 5]
    for _ in range(EPOCHS):
        for i in front:
            _, at, x = rows[i]
            w = weights_of(z[at], n[at])
            g = softmax(x @ w)
            g[labels[i]] -= 1.0
            g = x[:, None] * g
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights_of(z, n)
    scores = np.array([x @ w[at] for _, at, x in (rows[i] for i in back)]).reshape(-1, classes)
    truth = np.array([labels[i] for i in back], np.int64)
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.02, 5.0, 60) if len(truth) else ():
        loss = -np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        if loss < best:
            best, temperature = loss, float(t)
    return w, temperature


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Model from (doc_id, text, lang) with lang not NULL.

    What comes to the driver is a number for each feature, for each language, and for each
    pair of them.
    """
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    idf = np.zeros(DIM)
    seen = {r.feature: r.n for r in frequencies(train).collect()} if names else {}
    total = seen.pop(-1, 0)
    for k in range(DIM):
        idf[k] = np.log((1 + total) / (1 + seen.get(k, 0))) + 1.0
    if not names:
        return {"names": [], "idf": idf, "weights": np.zeros((DIM, 0)), "temperature": 1.0}
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, per_language / sizes[name]))])
    luck = F.pmod(F.xxhash64(F.lit("lid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = train.where(luck < share[F.col("lang")]).select("doc_id", "text", "lang").repartition(1)

    def work(batches):
        texts, langs, keys = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            texts += [t or "" for t in batch.column(1).to_pylist()]
            langs += batch.column(2).to_pylist()
        # Rows come in any order; this one is fixed.
        order = sorted(range(len(texts)), key=lambda i: (keys[i] is None, keys[i] or 0, texts[i]))
        texts, langs = [texts[i] for i in order], [langs[i] for i in order]
        rows = list(sparse_rows(texts, idf))
        w, temperature = train_model(rows, [names.index(langs[i]) for i, _, _ in rows], len(names))
        at = np.flatnonzero(np.abs(w).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array([*w[at].tolist(), [temperature] * len(names)], pa.list_(pa.float64()))], names=["feature", "w"]
        )

    weights, temperature = np.zeros((DIM, len(names))), 1.0
    for r in sample.mapInArrow(work, "feature long, w array<double>").collect():
        if r.feature < 0:
            temperature = r.w[0]
        else:
            weights[r.feature] = r.w
    return {"names": names, "idf": idf, "weights": weights, "temperature": temperature}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text; ``und`` and 0 where there is no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        names = np.array([*m["names"], UNKNOWN], object)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for i, j in chars.chunks(texts, documents=TOGETHER):
                counts, has = counted(texts[i:j])
                has &= len(names) > 1
                k = np.flatnonzero(has)
                if not len(k):
                    continue
                x = np.log1p(counts[k]) * m["idf"]
                x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
                p = softmax(x @ m["weights"] / m["temperature"])
                pred[i + k], score[i + k] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(np.minimum(score, 1.0))], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang).

    Only rows that are not held out and have a lang are learnt from; a NULL doc_id is not held
    out. NULL texts and texts without a letter are ``und`` with score 0, as is everything when
    nothing can be learnt. Repeated rows are predicted alike; an empty table gives no rows;
    other columns are ignored.
    """
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    out = predict(docs, fit(train, per_language))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
