"""Operators that link documents or vectors, against brute force and on odd rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from samples import BASE, rows

from barwright.llm import common, exact, lattice, simhash, tiles
from barwright.llm.common import components, stored


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items()}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fp = {d: fingerprint(t) for d, t in docs}
    ids = sorted(fp)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = groups(links, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf_dir).collect()}
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


@pytest.mark.parametrize("threshold", [0, 1, 3, 5])
def test_covering_loses_no_link(spark, threshold):
    rng = np.random.default_rng(threshold)
    centre = rng.integers(-(2**63), 2**63, 12, dtype=np.int64).tolist()
    ids = set(centre)
    for c in centre:
        for _ in range(25):
            for b in rng.choice(64, rng.integers(0, threshold + 3), replace=False).tolist():
                bit = 1 << b
                c ^= bit - (1 << 64) if bit >= 1 << 63 else bit
            ids.add(c)
    ids = sorted(ids)
    want = groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold], ids)
    edges = simhash.links(spark.createDataFrame([(i,) for i in ids], "id long"), threshold)
    got = groups([(r.a, r.b) for r in edges.collect()], ids)
    assert got == want


def test_tiles_of_a_large_bucket_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 7)
    base = 0x0123456789ABCDEF
    ids = sorted({base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)})
    edges = simhash.links(spark.createDataFrame([(i,) for i in ids], "id long"), 3).collect()
    assert len(set(groups([(r.a, r.b) for r in edges], ids).values())) == 1


def test_simhash_on_odd_rows(frame, odd):
    docs = frame(odd)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(odd)
    empty = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert {3, 4, 40} <= empty and all(r.component_id == 3 for r in got if r.doc_id in (3, 4, 40))
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and ids.count(None) == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_exact_on_odd_rows(spark, frame, odd):
    docs = frame(odd)
    got = exact.exact_duplicates(docs, capacity=2, max_depth=6).collect()
    assert len(got) == len(odd)
    same = [r for r in got if r.doc_id in (0, 1)]
    assert {r.keep_id for r in same} == {0} and {r.group_size for r in same} == {5}
    assert sum(r.kept for r in same) == 1
    blank = [r for r in got if r.doc_id in (3, 4, 40)]
    assert {r.keep_id for r in blank} == {4}  # three code points, the others none
    kept = exact.without_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.text_sha256 for r in got})
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    h = spark.range(4000).selectExpr("xxhash64(id) as h")
    got = exact.directory(h, capacity=100, max_depth=10).collect()
    held = {}
    for r in h.selectExpr("shiftrightunsigned(h, 54) as slot").collect():
        held[r.slot] = held.get(r.slot, 0) + 1
    size = {}
    for r in got:
        size[r.bucket] = size.get(r.bucket, 0) + held[r.slot]
    assert sum(size.values()) == 4000 and max(size.values()) <= 100 and len(size) >= 40


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, id long, key string")


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    x[100:200] = x[:100] + rng.normal(size=(100, 64)) * 0.05
    x[200:230] = x[0] + rng.normal(size=(30, 64)) * 0.1
    x[230:240] = x[5]  # copies
    x[240:250] = x[6] * 3.0
    data = [(i, v.astype(np.float32).tolist(), 0, 1, "k") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in lattice.near_duplicates(vectors(spark, data)).collect()}
    u = np.array([d[1] for d in data]) / np.linalg.norm([d[1] for d in data], axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    found, true = sum(r.n_links for r in got.values()), int(close.sum())
    assert 0.97 * true <= found <= true
    assert all(got[i].n_links <= close[i].sum() for i in got)
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(close), strict=True)], range(300))
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.99


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    near = lattice.decode(y)
    whole, half = lattice.roots()
    for step in np.concatenate([whole, half]):
        assert (((y - near) ** 2).sum(1) <= ((y - near - step) ** 2).sum(1) + 1e-9).all()
    assert ((near.sum(1) % 2) == 0).all() and ((near * 2 % 2).std(1) == 0).all()


def test_lattice_on_odd_rows(spark):
    one = [1.0] + [0.0] * 7
    data = [(0, one, 1, 5, "k"), (1, one, None, None, None), (1, one, 1, 5, "k"), (2, None, 1, 1, "k"), (3, [], 1, 1, "k"),
            (4, [0.0] * 8, 1, 1, "k"), (5, [float("nan")] * 8, 1, 1, "k"), (6, [None] * 8, 1, 1, "k"),
            (7, [float("inf")] + [0.0] * 7, 1, 1, "k"), (8, [1.0, 0.0], 1, 1, "k"), (None, one, 1, 1, "k")]
    got = lattice.near_duplicates(vectors(spark, data)).collect()
    assert len(got) == len(data)
    by = {r.vec_id: r for r in got}
    assert by[0].n_links == 2 and by[1].component_id == 0 and not by[1].kept
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(2, 9))
    assert lattice.near_duplicates(vectors(spark, [])).count() == 0


def test_near_copies_of_a_large_group_stay_one(frame):
    words = (BASE * 12).split()
    texts = []
    for i in range(60):
        w = list(words)
        w[i * 5 % len(w)] = f"changed{i}"
        texts.append(" ".join(w))
    got = simhash.near_duplicates(frame(rows(texts))).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in got}
    want = groups([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], sorted(fp))
    assert {r.doc_id: r.component_id for r in got} == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_that_grows_with_the_corpus_is_broadcast(spark, monkeypatch, tmp_path):
    """Tables that Spark takes for small, as they are exploded or aggregated from small files."""
    plans = []

    def seen(df, label):
        plans.append(plan_of(df))
        return stored(df, label)

    for module in (common, simhash, exact):
        monkeypatch.setattr(module, "stored", seen)
    path = str(tmp_path / "docs")
    texts = [f"{BASE} line {i // 2} of the text" for i in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    fps = simhash.fingerprints(docs).select(F.col("fp").alias("id")).distinct()
    plans.append(plan_of(tiles.dealt(simhash.anchors(fps, 3))))
    plans.append(plan_of(tiles.dealt(simhash.anchors(fps, 3), fps.withColumn("more", F.lit(1)))))
    kept = simhash.without_near_duplicates(docs)
    plans.append(plan_of(kept))
    assert "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)
    stay = exact.without_exact_duplicates(docs)
    assert sorted(r.doc_id for r in stay.collect()) == list(range(0, 40, 2))
    # The one broadcast is that of the directory, which MAX_DEPTH bounds, in the plan that writes the index.
    assert "Broadcast" not in plan_of(stay)
