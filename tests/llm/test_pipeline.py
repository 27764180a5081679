from __future__ import annotations

from collections import Counter

import corpus_pipeline
from codestrata.llm import mixing, near_dup, packing, pii, quality
from codestrata.llm.queries import ORACLE, QUERIES


def test_each_stage_takes_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        kept.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = kept[-1][1]
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    (raw, good), (_, single), (_, clean), (_, mixed), (_, packed) = kept
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == {r.row.doc_id for r in quality.judged(raw).where("kept").collect()}
    assert ids(single) == {r.class_id for r in near_dup.labelled(good).collect()}
    assert near_dup.labelled(single).count() == single.count()
    texts = {r.doc_id: r.text for r in single.collect()}
    spans = {r.row.doc_id: len(r.spans) for r in pii.found(single).collect()}
    for r in clean.collect():
        assert (r.text == texts[r.doc_id]) == (spans[r.doc_id] == 0) and r.n_chars == len(r.text)
    assert pii.found(clean).where("exists(spans, s -> s.kind in ('email', 'ip', 'card', 'phone'))").count() == 0
    copies = {r.doc_id: r.copies for r in mixing.sampled(clean, weight=mixing.log_size).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert packed.count() == mixed.count()
    run = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, packed.collect()))


def test_empty_null_and_clashing_input(spark, awkward, nothing, sf):
    assert corpus_pipeline.run_on(spark, nothing, sf).count() == 0
    out = corpus_pipeline.run_on(spark, awkward, sf)
    assert out.columns == ["doc_id", "length", "bucket", "padded", "batch", "slot"]
    rows = out.collect()
    ids = {r.doc_id for r in awkward.collect()}
    assert rows and {r.doc_id for r in rows} <= ids and all(r.length >= 1 for r in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)


def test_stages_and_queries_are_named():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
    assert packing.best_bounds is not None
