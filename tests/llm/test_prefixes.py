"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from barwright.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "c") for r in rows], SCHEMA)


def by_hand(paths):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of {conv_id: [(role, text)]}."""
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    out = {}
    kids, leaves, saved = {}, {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        kids.setdefault(n, 0)
        own = (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
        leaves[n] = leaves.get(n, 0) + (kids[n] == 0)
        saved[n] = saved.get(n, 0) + own
        if n:
            up = n[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[n]
            saved[up] = saved.get(up, 0) + saved[n]
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(n))
        out[min(members), len(n)] = (min(nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def in_order(rows):
    paths = {}
    for c, turn, role, text in rows:
        if c is not None:
            paths.setdefault(c, []).append((turn, role or "", text or ""))
    first = lambda t: t[0] is not None
    # Ties go by the digest of role and text.
    sha = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()
    return {c: [(r, x) for _, r, x in sorted(p, key=lambda t: (first(t), t[0] or 0, sha(t)))] for c, p in paths.items()}


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = paths.get(base, [])[:h] + own[h:]
    return out


def branching(seed, n, depth, letters="ab"):
    """Conversations that leave one another at all depths, some of them alike."""
    rng = random.Random(seed)
    rows, made = [], []
    for c in range(n):
        base = rng.choice(made) if made and rng.random() < 0.8 else []
        p = base[: rng.randint(0, len(base))] + [rng.choice(letters) * rng.randint(0, 3) for _ in range(rng.randint(0, depth))]
        p = p[:depth]
        made.append(p)
        rows += [(c * 3, i, "user" if i % 2 else "é", t) for i, t in enumerate(p)]
    return rows


@pytest.mark.parametrize("band", [1, 2, 3, 32])
def test_trie_equals_one_by_hand(spark, band):
    rows = branching(band, 30, 23)
    turns = prefixes.numbered(frame(spark, rows).repartition(5)).cache()
    convs = turns.groupBy("conv_id").agg({"i": "max"}).withColumnRenamed("max(i)", "size")
    if band > 1:
        nodes, ends = prefixes.trie(turns, convs, band)
        assert found(prefixes.with_ends(nodes, ends)) == by_hand(in_order(rows))


def test_rebuilt_conversations_nulls_ties_and_repeats(spark):
    rows = branching(9, 40, 12, "abc")
    rows = [(c // 3, t, r, x) for c, t, r, x in rows]
    rows += [(7, 1, "user", "same"), (7, 1, "user", "same"), (7, 1, None, None), (7, None, "user", None), (7, None, "z", "first")]
    rows += [(None, 1, "user", "left out"), (-3, 1, "user", "x"), (-5, 2, "user", "x"), (-4, 1, None, ""), (101, 0, "user", "only one")]
    rows += [(10**15 + 1, i, "user", "long " * 20_000) for i in range(3)]
    rng = random.Random(1)
    rng.shuffle(rows)
    nodes, ends = prefixes.trie(*prefixes.rebuilt(prefixes.numbered(frame(spark, rows).repartition(7))))
    want = by_hand(rebuilt(in_order(rows)))
    assert found(prefixes.with_ends(nodes, ends)) == want
    assert ends.count() == len({r[0] for r in rows} - {None})


def test_one_conversation_and_one_first_turn_hold_most_rows(spark):
    """A conversation of many turns is numbered over several tasks; many end at one node."""
    rows = [(5, i, "user", f"t{i % 7}") for i in range(1500)] + [(c, 0, "user", "hi") for c in range(100, 700)]
    df = frame(spark, rows).repartition(9)
    turns = prefixes.numbered(df).cache()
    assert sorted(r.i for r in turns.where("conv_id = 5").collect()) == list(range(1, 1501))
    convs = turns.groupBy("conv_id").agg({"i": "max"}).withColumnRenamed("max(i)", "size")
    got = found(prefixes.with_ends(*prefixes.trie(turns, convs)))
    assert got[100, 1][1] == 600 and got[5, 0][1:4] == (601, 2, 2) and len(got) == 1502
    assert got[100, 1][5] == hashlib.sha256(",".join(map(str, range(100, 700))).encode()).hexdigest()
    assert got[100, 1][4] == 599 * 2 == got[5, 0][4]


def test_empty_table_and_only_turnless(spark):
    none = frame(spark, [(1, 1, "u", "x")]).limit(0)
    assert found(prefixes.with_ends(*prefixes.trie(*prefixes.rebuilt(prefixes.numbered(none))))) == {}
    # crc32("11") % 9 is above 1 and there is no conversation 10.
    assert zlib.crc32(b"11") % 9 > 1
    one = frame(spark, [(11, 1, "u", "x")])
    got = found(prefixes.with_ends(*prefixes.trie(*prefixes.rebuilt(prefixes.numbered(one)))))
    assert got == {(11, 0): (None, 1, 0, 1, 0, hashlib.sha256(b"11").hexdigest())}
