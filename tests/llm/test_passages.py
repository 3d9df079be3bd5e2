"""Passages whose seeds are few, frequent or all the same."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_texts import digest, passage, removal

from barwright.llm import substring, suffix


def found(spark, texts, tasks=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(tasks)
    got = substring.passages(docs).collect()
    assert all(r.ref_doc_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8 for r in got)
    return {(r.doc_id, r.ref_doc_id) for r in got}


def test_passages_of_lines_that_stand_apart_in_earlier_documents(spark):
    """Few and many earlier copies of each line, joined as they are or with another word between."""
    rng = random.Random(3)
    texts, want = [], set()
    for copies in (1, 3, 12, 40):
        for joint in ("", "changed"):
            one, two = passage(rng, 30), passage(rng, 30)
            for line in [one] * copies + [two] * copies:
                texts.append(f"{passage(rng, 20)} {line} {passage(rng, 20)}")
            for word in (joint, joint and "other"):
                texts.append(f"{passage(rng, 25)} {one} {word} {two} {passage(rng, 25)}")
            want.add((len(texts) - 1, len(texts) - 2))
    for tasks in (1, 5):
        assert found(spark, texts, tasks) == want


def test_passages_of_frequent_lines_with_other_gaps(spark, monkeypatch):
    """Five lines of 12 words, few or many copies of each, with one word between them here and two there."""
    rng = random.Random(12)
    texts, want = [], set()
    for copies in (3, 12, 40):
        lines = [passage(rng, 12) for _ in range(5)]
        for line in lines * copies:
            texts.append(f"{passage(rng, 20)} {line} {passage(rng, 20)}")
        for gap in (1, 2):
            texts.append(" ".join([passage(rng, 20), *[f"{line} {passage(rng, gap)}" for line in lines], passage(rng, 20)]))
        want.add((len(texts) - 1, len(texts) - 2))
    for tasks in (1, 3, 7):
        assert found(spark, texts, tasks) == want
    monkeypatch.setattr(substring, "FULL", 16)  # buckets are reduced on the way
    assert found(spark, texts, 7) == want


def test_a_document_that_many_refer_to(spark, monkeypatch):
    monkeypatch.setattr(substring, "WANTED", 5)
    rng = random.Random(13)
    shared = passage(rng, 70)
    texts = [f"{passage(rng, 20)} {shared} {passage(rng, 20)}" for _ in range(60)]
    assert {d for d, _ in found(spark, texts, 3)} == set(range(1, 60))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(1 << 62), 1 << 62, 1000), np.arange(1000) << 16, np.zeros(1000, np.int64)]
    back = substring.unpacked(np.frombuffer(substring.packed(*columns), np.uint8), 1000, 3)
    assert all((a == b).all() for a, b in zip(columns, back, strict=True))


def test_passages_near_the_least_similarity(spark):
    """50 to 60 words, every fifth or sixth of them or as many at random replaced."""
    rng = random.Random(4)
    texts, want = [], set()
    for n in range(50, 61):
        for step in (5, 6, 0):
            shared = passage(rng, n).split()
            texts.append(f"{passage(rng, 40)} {' '.join(shared)} {passage(rng, 40)}")
            # The ends stay, as a passage begins and ends with equal words.
            for i in range(step - 1, n - 1, step) if step else rng.sample(range(1, n - 1), n // 5):
                shared[i] = f"new{i}"
            texts.append(f"{passage(rng, 30)} {' '.join(shared)} {passage(rng, 30)}")
            want.add((len(texts) - 1, len(texts) - 2))
    assert found(spark, texts) == want


def test_passages_of_one_word_or_phrase_repeated(spark):
    rng = random.Random(6)
    texts, want = [], set()
    for phrase, copies in (("ha", 60), ("ho hum", 30), ("one two three", 25), ("a b c d e f g", 9)):
        for _ in range(2):
            texts.append(f"{passage(rng, 30)} {' '.join([phrase] * copies)} {passage(rng, 30)}")
        want.add((len(texts) - 1, len(texts) - 2))
    assert found(spark, texts) == want


def test_large_buckets_are_split(spark, monkeypatch):
    """A short line in every document, with text of its own around it in most and shared in some."""
    monkeypatch.setattr(suffix, "SPLIT", 20)
    rng = random.Random(8)
    texts = [f"{passage(rng, 12)} All rights reserved by us. {passage(rng, 12)}" for _ in range(150)]
    texts += [texts[i][len(texts[i]) // 2 - 45 :] + passage(rng, 5) for i in range(0, 150, 3)]
    texts += [passage(rng, 5) + texts[i][: len(texts[i]) // 2 + 45] for i in range(1, 150, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = removal([(i, t.encode()) for i, t in enumerate(texts)], 50)
    for tasks in (1, 7):
        assert digest(suffix.without_repeats(docs.repartition(tasks)).collect()) == want
    asked = suffix.decided(suffix.marked(docs, 50, suffix.SEED)).where("seed is not null")
    assert asked.groupBy("seed").count().agg(F.max("count")).first()[0] > 20
    pieces = suffix.dealt(asked, docs, 50).where("b is null")
    assert pieces.where("piece is not null").groupBy("seed").count().agg(F.max("count")).first()[0] <= 20
    assert pieces.where("piece is null").groupBy("seed").count().agg(F.max("count")).first()[0] <= 20
