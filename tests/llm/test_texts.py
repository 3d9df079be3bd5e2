"""Operators on repeated strings, tokens, licences, languages, quality and mixes."""

import hashlib
import random
import re

import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken
from samples import BASE, rows
from hypothesis import given, settings, strategies as st

from barwright import llm
from barwright.llm import bpe, language, license, mixing, quality, substring, suffix

QUERIES, ORACLES = llm.load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == []


# Repeated strings


def removal(docs, least):
    first = {}
    for d, t in docs:
        for i in range(len(t) - least + 1):
            k = t[i : i + least]
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        out.setdefault(d, set()).add((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digest(rows_):
    out = {}
    for r in rows_:
        out.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()))
    return out


def test_suffix_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = suffix.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert digest(out.collect()) == removal(docs, 50)


def test_suffix_on_few_letters(spark, monkeypatch):
    """Ties, overlaps and runs of one letter, in many tasks and with several documents in one."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 160))) for _ in range(80)]
    texts += ["a" * n for n in (5, 30, 31, 90)] + ["ab" * 40, "ba" * 41, "é" * 40, texts[3] + texts[4], texts[3][5:] + "zz" + texts[4]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = removal([(i, t.encode()) for i, t in enumerate(texts)], 12)
    for tasks in (1, 7):
        assert digest(suffix.without_repeats(docs.repartition(tasks), least=12, seed=4).collect()) == want


def test_maximal_repeats_by_definition():
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abc") for _ in range(40)) for _ in range(12)] + [b"abcabcabcabcabc"] * 2
    got = {}
    for n, piece, place in suffix.repeats(pieces, 4):
        at = sorted(zip(piece.tolist(), place.tolist(), strict=True))
        strings = {pieces[p][i : i + n] for p, i in at}
        assert len(strings) == 1
        got[strings.pop()] = at
    every = {}
    for p, t in enumerate(pieces):
        for i in range(len(t)):
            for j in range(i + 4, len(t) + 1):
                every.setdefault(t[i:j], []).append((p, i))
    want = {}
    for s, at in every.items():
        left = {pieces[p][i - 1] if i else (p, i) for p, i in at}
        right = {pieces[p][i + len(s)] if i + len(s) < len(pieces[p]) else (p, i) for p, i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            want[s] = sorted(at)
    # Suffixes shorter than the least length are not in the array; strings have them all.
    assert got == want


def test_suffix_on_odd_rows(frame, odd):
    out = suffix.without_repeats(frame(odd)).collect()
    assert len(out) == len(odd)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(len(r.kept) == r.n_bytes for r in by[0]) and by[1][0].kept == b"" and by[2][0].kept == b" again"
    assert all(len(r.kept) == r.n_bytes for r in by[None]) and by[40][0].n_bytes == 0
    assert suffix.without_repeats(frame(odd).limit(0)).count() == 0


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_passages_exact_and_fuzzy_are_found_and_clean_documents_left(spark):
    rng = random.Random(11)
    shared = passage(rng, 70)
    changed = shared.split()
    for i in (12, 30, 48):
        changed[i] = "other"
    del changed[55]
    texts = [passage(rng, 200) for _ in range(40)]
    texts[3] += " " + shared + " " + passage(rng, 30)
    texts[9] = passage(rng, 25) + " " + " ".join(changed) + " " + passage(rng, 40)
    texts[20] = shared.upper() + " " + texts[20]
    texts[25] += " " + " ".join(shared.split()[:35])  # too short to count
    got = substring.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in got} == {(9, 3), (20, 3)}
    by = {r.doc_id: r for r in got}
    assert by[20].n_words == 70 and by[20].similarity == 1.0 and (by[20].ref_start, by[20].ref_end) == (200, 270)
    assert by[9].n_words >= 68 and 0.8 <= by[9].similarity < 1


def test_every_exact_passage_is_covered(spark, sf_dir):
    docs = [(r.doc_id, re.findall("[^\x20\x09-\x0d]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})))
            for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    first, want, got = {}, {}, {}
    for d, w in sorted(docs):
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if first.setdefault(k, d) < d:
                want.setdefault(d, set()).update(range(i, i + 50))
    for r in substring.query(spark, sf_dir).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.ref_doc_id < r.doc_id and r.similarity >= 0.8
    assert set(want) <= set(got)
    assert sum(len(want[d] - got[d]) for d in want) <= 0.01 * sum(map(len, want.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=14, unique=True))
def test_best_chain_has_the_best_score(links):
    links = sorted(links, key=lambda p: (p[0], -p[1]))
    x, y = [p[0] for p in links], [p[1] for p in links]
    best = [0.0] * len(links)
    for i in range(len(links)):
        best[i] = substring.K
        for j in range(i):
            if x[j] < x[i] and y[j] < y[i]:
                best[i] = max(best[i], best[j] + substring.K - substring.GAP_COST * (x[i] - x[j] + y[i] - y[j]))
    found = substring.chains(x, y)
    assert sorted(i for c in found for i in c) == list(range(len(links)))
    c = found[0]
    assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:], strict=False))
    score = substring.K * len(c) - substring.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(c, c[1:], strict=False))
    assert score == pytest.approx(max(best))


def test_passages_on_odd_rows(frame, odd):
    got = substring.passages(frame(odd)).collect()
    assert {r.doc_id for r in got} == {1, 2, 7} and all(r.ref_doc_id < r.doc_id and r.ref_doc_id in (0, 1, 2) for r in got)
    assert substring.passages(frame(odd).limit(0)).count() == 0


# Tokens

RANKS = bpe.vocabulary()
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(texts):
    ids, at, _, _ = bpe.Encoder(RANKS).encode(texts)
    return [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'strevlmd  \n\t!9é中 　\x85²"), st.characters(max_codepoint=0xFFFF, categories=["L", "N", "P", "S", "Z"])), max_size=30), max_size=5))
def test_ids_equal_the_library(texts):
    assert ids_of(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_classes_of_every_plane_follow_the_library():
    texts = [f"a{chr(c)}a 1{chr(c)}1" for c in range(0x80, 0x32000, 7) if not 0xD800 <= c < 0xE000]
    assert ids_of(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_long_slices_and_whole_documents(spark, sf_dir):
    texts = ["ab" * 4000, " " * 3000, "x" * 20001, "", "'ll" * 50] + [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert ids_of(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_round_trip_offsets_and_odd_rows(frame, odd):
    docs = frame(odd)
    encoded = bpe.encode(docs, RANKS)
    by = {r.doc_id: r for r in encoded.collect() if r.doc_id is not None}
    data = {r.doc_id: bytes(r.data) for r in bpe.decode(encoded, RANKS).collect()}
    for d, t in {(r[0], r[1]) for r in odd if r[0] is not None}:
        t = t or ""
        assert data[d] == t.encode() and by[d].ids == REFERENCE.encode_ordinary(t)
        slices = [t[i:j] for i, j in zip(by[d].offsets, [*by[d].offsets[1:], len(t)], strict=True)] if by[d].offsets else []
        assert "".join(slices) == t and [x for s in slices for x in REFERENCE.encode_ordinary(s)] == by[d].ids
    digests = {r.doc_id: r for r in bpe.digests(docs, RANKS).collect()}
    assert digests[40].n_tokens == 0 and digests[40].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs.limit(0), RANKS).count() == 0


def test_scan_follows_each_function():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 4, (50, 4)).astype(np.uint8)
    state, want = bpe.FREE, []
    for step in f:
        want.append(state)
        state = step[state]
    assert bpe.scan(f).tolist() == want


# Licences


def test_license_places_and_odd_rows(frame, odd):
    texts = ["GNU General Public License, gnu-general public LICENSE", "cc by cc by nc 4 0", "the mit licensed", "Apache\x0bLicense Version 2.0", None, "mit  license " * 40]
    got = {r.doc_id: r for r in license.scan(frame(rows(texts))).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 0, 4, "gpl")
    assert got[1].n_base == 2 and got[1].labels == "cc-by,cc-by-nc"
    assert got[2].n_base == 0 and got[2].first_word is None and got[2].score == 0
    assert got[3].labels == "apache,apache-2.0" and got[3].score == 1
    assert got[4].n_words == 0 and got[4].labels == ""
    assert got[5].n_base == 40 and got[5].last_word == 78
    assert license.scan(frame(odd)).count() == len(odd) and license.scan(frame(odd).limit(0)).count() == 0


# Languages and quality


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language.query(spark, sf_dir).collect() if r.held_out]
    assert held and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_language_on_odd_rows(frame, odd):
    got = language.identify(frame(odd)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[40].lang_pred == "und" and by[3].lang_pred == "und" and by[0].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert language.identify(frame(odd).limit(0)).count() == 0
    unlabelled = language.identify(frame([r[:2] + (None,) + r[3:] for r in odd])).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in quality.query(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.95


def test_risk_without_negatives_separates():
    rng = np.random.default_rng(0)
    positive = rng.normal(1, 1, (500, quality.WIDTH))
    unlabelled = np.vstack([rng.normal(1, 1, (700, quality.WIDTH)), rng.normal(-1, 1, (300, quality.WIDTH))])
    positive[:, 0] = unlabelled[:, 0] = 1
    w, scale, shift = quality.fit_weights(positive, unlabelled, 0.7)
    s = np.clip((unlabelled - shift) / scale, -8, 8) @ w
    assert (s[:700] > 0).mean() > 0.95 and (s[700:] < 0).mean() > 0.95


def test_quality_on_odd_rows(spark, frame, odd):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, None), (2, 1, 1), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(frame(odd), labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = quality.score(frame(odd), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.accepted(frame(odd), labels).columns == frame(odd).columns
    assert quality.score(frame(odd).limit(0), labels).count() == 0


# Mixes


def test_mix_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.query(spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
        assert r.taken in (0, r.size, 2 * r.size)
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    free = [target[s] / weight[s] for s in sizes if target[s] < 2 * sizes[s] - 1e-6]
    assert max(free) == pytest.approx(min(free)) and all(target[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.query(spark, sf_dir).collect()))


def test_mix_on_odd_rows(frame, odd):
    docs = frame(odd)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(odd) and all(r.copies == 0 for r in got if r.size == 0) and max(r.copies for r in got) <= 2
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r.target for r in mixing.mixed(frame(rows(["", None]))).collect()} == {0.0}
    assert BASE
