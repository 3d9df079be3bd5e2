"""License scans with a positional index of rare template words.

Every template is a sequence of words with a mandatory key phrase. Document frequencies of
all template words are counted over the whole corpus; the ``RARE`` words of highest inverse
document frequency of each key phrase are its postings, with their places in the template.
In a document the places of such words, less their places in the template, are places where
the template could start; places on which the rare words agree are those where the key
phrase is compared word by word. As a phrase's place holds all its words, none is missed.
Only DataFrame functions are used; documents do not move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.llm.common import ascii_lower, documents

NAME = "op3_license_scan"
RARE = 2

# Phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further templates, each a label, the words around, and the key phrase in them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
]


def all_templates() -> list[tuple[str, list[str], list[str], int, bool]]:
    """(label, words, key phrase, its place in them, whether of the contract)."""
    out = [(label, phrase.split(), phrase.split(), 0, True) for phrase, label in BASE.items()]
    for label, text, key in TEMPLATES:
        words, k = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        out.append((label, words, k, at, False))
    return out


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def rarity(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each word of a key phrase, over all of ``docs``.

    One number for each such word comes to the driver, as many as the templates name.
    """
    vocabulary = sorted({w for _, _, key, _, _ in all_templates() for w in key})
    known = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words_of(F.col("text")))
    counts = docs.select(F.explode(known).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    seen = {r.w: r.n for r in counts.collect()}
    return {w: -math.log(1.0 + seen.get(w, 0)) for w in vocabulary}


def _starts(word: str, place: int) -> Column:
    """Places where a template could start, by one posting."""
    at = F.filter("hits", lambda i: F.get("words", i) == word)
    return F.transform(at, lambda i: i - place)


def _places(key: list[str], at: int, rare: list[tuple[str, int]]) -> Column:
    """Places where the template could start by all its postings, and has its key phrase."""
    starts = _starts(*rare[0])
    for posting in rare[1:]:
        starts = F.array_intersect(starts, _starts(*posting))
    phrase = F.array(*[F.lit(w) for w in key])
    return F.filter(
        starts,
        lambda o: (o + at >= 0) & (F.slice("words", F.greatest(o + at + 1, F.lit(1)), len(key)) == phrase),
    )


def _cover(places: str, words: list[str]) -> Column:
    """At each place, the part of the template's words that stand where they should."""
    return F.transform(
        places,
        lambda o: sum((F.when(F.get("words", o + j) == w, 1).otherwise(0) for j, w in enumerate(words)), F.lit(0))
        / len(words),
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    NULL and empty texts have no words, no places and the score 0. The score is 1 where a
    phrase of the contract stands, else the largest part of a template's words that stand in
    place around its key phrase. Repeated rows are scanned alike; an empty table gives no
    rows; columns other than doc_id and text are ignored.
    """
    idf = rarity(docs)
    templates = all_templates()
    rare = []
    for _, _, key, at, _ in templates:
        best = sorted(set(key), key=lambda w: (-idf[w], w))[:RARE]
        rare.append([(w, at + key.index(w)) for w in best])
    lookup = sorted({w for ws in rare for w, _ in ws})
    n = F.size("words")
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "words", F.filter(every, lambda i: F.get("words", i).isin(lookup)).alias("hits"))
    places = [_places(key, at, rare[k]).alias(f"p{k}") for k, (_, _, key, at, _) in enumerate(templates)]
    covers = [k for k, t in enumerate(templates) if not t[4]]
    rows = rows.select("doc_id", "words", *places)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *[f"p{k}" for k in range(len(templates))],
                       *[F.coalesce(F.array_max(_cover(f"p{k}", templates[k][1])), F.lit(0.0)).alias(f"c{k}") for k in covers])
    first = [k for k, t in enumerate(templates) if t[4]]
    all_places = F.concat(*[F.col(f"p{k}") for k in first])
    named = lambda ks: F.concat_ws(",", F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(templates[k][0])) for k in ks]), lambda x: x.isNotNull()))))
    score = F.when(F.size(all_places) > 0, F.lit(1.0)).otherwise(F.greatest(*[F.col(f"c{k}") for k in covers]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        named(first).alias("base_labels"),
        named(range(len(templates))).alias("labels"),
        score.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    templates = all_templates()
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    place = lambda k: (
        f"list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(templates[k][2])}] = {listed(templates[k][2])})"
    )
    base = [k for k, t in enumerate(templates) if t[4]]
    extra = [k for k, t in enumerate(templates) if not t[4]]
    cover = lambda k: (
        f"coalesce(list_max(list_transform(p{k}, lambda i: ("
        + " + ".join(
            f"CASE WHEN i - {templates[k][3]} + {j} >= 0 AND w[i - {templates[k][3]} + {j} + 1] = '{x}' THEN 1 ELSE 0 END"
            for j, x in enumerate(templates[k][1])
        )
        + f") / {float(len(templates[k][1]))})), 0)"
    )
    names = lambda ks: "array_to_string(list_sort(list_filter([" + ", ".join(
        f"CASE WHEN len(p{k}) > 0 THEN '{templates[k][0]}' END" for k in ks
    ) + "], lambda x: x IS NOT NULL)), ',')"
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (SELECT *, {", ".join(f"{place(k)} AS p{k}" for k in range(len(templates)))} FROM d
), a AS (SELECT *, {" || ".join(f"p{k}" for k in base)} AS every FROM p)
SELECT doc_id, len(w) AS n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
       {names(base)} AS base_labels, {names([*base, *extra])} AS labels,
       CAST(CASE WHEN len(every) > 0 THEN 1 ELSE greatest({", ".join(cover(k) for k in extra)}) END AS DOUBLE) AS score
FROM a
"""


SQL = _sql()
