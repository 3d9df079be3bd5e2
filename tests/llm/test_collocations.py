"""Collocations against counts by hand, with tries, blocks and bitmaps made small."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barwright.llm import collocations as co


def by_hand(rows, least, first=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = []
    big = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    for (lang, w), a in big.items():
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [b for (m, v), b in big.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 50 * a for b in longer):
            kept.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out, rank = set(), Counter()
    for lang, score, a, phrase, l, r, total in sorted(kept):
        rank[lang] += 1
        if rank[lang] <= first:
            out.add((lang, rank[lang], phrase.decode(), -a, l, r, total, -score))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "of", "é", "中文", "x\x00y", "z" * 300, "don't", "\u00a0", "-"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"]
    out = []
    for i in range(n):
        t = "".join(rng.choice(words[: 3 + i % 10]) + rng.choice(gaps[: 2 + i % 9]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None, "und", "a\nb"]), t))
    return [*out, ("en", None), ("en", ""), ("de", " \t\n"), (None, None), *out[:5], *out[:5]]


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, "f", 1, "p") for lang, t in rows], "lang string, text string, f string, n int, phrase string")


def test_equals_counts_by_hand_with_all_bounds_small(spark, monkeypatch):
    rows = texts(3, 60)
    whole = co.collocations(frame(spark, rows).repartition(3), 4)
    assert {tuple(r) for r in whole.collect()} == by_hand(rows, 4)
    # Blocks of few bytes, bitmaps that collide all the time, many tries, few rows held.
    monkeypatch.setattr(co, "BLOCK", 16)
    monkeypatch.setattr(co, "HELD", 8)
    docs = frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(4)
    heavy, bitmaps = co.sieved(docs, 4, bits=6)
    counts = co.counted(docs, co.candidates(docs, heavy, bitmaps), bitmaps, trie_bytes=1000)
    phrases = co.scored(counts, co.word_totals(docs), 4)
    got = co.first_of_each(co.without_covered(phrases)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == by_hand(rows, 4)


def test_blocks_hold_every_phrase_once():
    rng = random.Random(4)
    for size in (1, 3, 7, 50, 10_000):
        text = "".join(rng.choice("ab  .") for _ in range(400))
        seen = Counter()
        for w in co.blocks(np.frombuffer(text.encode(), np.uint8), size):
            raw = w.data.tobytes()
            for i in range(w.count):
                for k in range(1, int(w.follow[i]) + 2):
                    seen[tuple(raw[w.start[j] : w.end[j]] for j in range(i, i + k))] += 1
        want = Counter()
        for piece in re.split("[.]", text):
            ws = piece.encode().split()
            for k in (1, 2, 3):
                want.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        assert seen == want


def test_double_array_accepts_its_keys_only():
    rng = random.Random(8)
    for n in (0, 1, 2, 40, 3000):
        keys = list({bytes(rng.choice(b"abc\x00\xff ") for _ in range(rng.randint(1, 9))) for _ in range(n)})
        base, check, accept, at = co.double_array(np.frombuffer(b"".join(keys), np.uint8), np.cumsum([0, *map(len, keys)]))
        for i, k in enumerate(keys):
            assert co._walk((base, check), k) == at[i] and accept[at[i]] == i
        for _ in range(300):
            k = bytes(rng.choice(b"abc\x00\xff ") for _ in range(rng.randint(1, 10)))
            s = co._walk((base, check), k)
            assert (s >= 0 and accept[s] >= 0) == (k in keys)
        assert len(base) <= 4 * sum(map(len, keys)) + 1024


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "x", 1, 3 * big + 1), ("en", "y", 1, 7 * big + 3), ("en", "x y", 2, 3 * big - 7), ("en", "x x", 2, 12)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    got = {r.phrase: r for r in co.scored(counts, spark.createDataFrame([("en", 10**14)], "lang string, n long")).collect()}
    for p, a, right in (("x y", 3 * big - 7, 7 * big + 3), ("x x", 12, 3 * big + 1)):
        assert got[p].score == 1000000 * a * a // ((3 * big + 1) * right) and (got[p].a, got[p].r) == (a, right)


def test_ranks_of_a_language_with_most_phrases(spark):
    rows = [("en", f"p{i}", 2, 10 + i % 3, 1, 1, 1, i % 50) for i in range(900)] + [("de", "q", 2, 10, 1, 1, 1, 5)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l long, r long, n long, score long")
    got = sorted((r.lang, r.rank, r.phrase) for r in co.first_of_each(df, 20).collect())
    order = sorted((-r[7], -r[3], r[1].encode()) for r in rows if r[0] == "en")[:20]
    assert got == [("de", 1, "q"), *[("en", i + 1, p.decode()) for i, (_, _, p) in enumerate(order)]]


def test_odd_and_empty_tables(spark, frame, odd):
    got = co.collocations(frame(odd), 2)
    assert {tuple(r) for r in got.collect()} == by_hand([(r[2], r[1]) for r in odd], 2)
    assert co.collocations(frame(odd).limit(0)).count() == 0
    assert co.collocations(frame(odd), 10**6).count() == 0
