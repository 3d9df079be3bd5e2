"""Each stage against the operator it calls, on its own input, and the pipeline on odd rows."""

import hashlib

import corpus_pipeline
from test_texts import REFERENCE

from barwright.llm import exact, mixing, quality, simhash


def test_each_stage_follows_its_operator(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((docs, out))
        docs = out
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert all(a.columns == b.columns for a, b in kept[:-1])
    before, after = kept[0]
    assert ids(after) == ids(quality.score(before, labels).where("predicted = 1"))
    before, after = kept[1]
    assert ids(after) == ids(exact.exact_duplicates(before).where("kept"))
    before, after = kept[2]
    assert ids(after) == ids(simhash.near_duplicates(before).where("doc_id = component_id"))
    before, after = kept[3]
    assert ids(after) == sorted(r.doc_id for r in mixing.mixed(before).collect() for _ in range(r.copies))
    before, after = kept[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert ids(after) == ids(before)
    for r in rows:
        ids_ = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids_) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_on_odd_rows(spark, sf_dir, frame, odd, tmp_path):
    for n, docs in enumerate((frame(odd), frame(odd).limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
        assert (docs.count() == 0) == (n == 1)
