from __future__ import annotations

import corpus_pipeline
from evidentry.llm import pii
from tests.llm import test_decontam, test_minhash, test_packing
from tests.llm.samples import empty, frame, rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(spark, docs, sf_dir):
    """The stages re-stated one document at a time: (doc_id, text) before packing."""
    kept = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    stays = set(test_minhash.slow_kept(kept))
    one = [(d, t) for d, t in kept if d in stays]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {d for d, _, h, _ in test_decontam.slow(one, items) if h}
    out = []
    for d, t in one:
        if str(d) in hit:
            continue
        end, parts = 0, []
        for start, stop, kind in sorted(((s, e, k) for k, s, e in pii.base_spans(t)), key=lambda x: (x[0], -x[1])):
            if start >= end:
                parts += [t[end:start], f"<{kind}>"]
            end = max(end, stop)
        out.append((d, "".join([*parts, t[end:]])))
    return out


def test_stages_on_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = plain(spark, [(r.doc_id, r.text) for r in docs.collect()], sf_dir)
    found = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, sf_dir)
        assert found.columns == COLUMNS
    found = found.collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted(expected)
    assert all(r.n_chars == len(r.text) for r in found)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    test_packing.check_packing(packed, expected)


def test_awkward_rows_go_through(spark, sf_dir):
    docs = frame(spark).selectExpr("doc_id", "text", "lang", "CAST(NULL AS STRING) AS source", "CAST(length(text) AS LONG) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert ids.count(107) == 0 and ids.count(None) <= 1
    assert docs.count() > 0
    assert len(rows()) > len(ids)


def test_empty_table(spark, sf_dir):
    docs = empty(spark).selectExpr("doc_id", "text", "lang", "fp AS source", "CAST(row AS LONG) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
