from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentry.llm import langid, quality
from evidentry.llm.queries import op7_language, op10_quality
from tests.llm.samples import empty, frame, rows


def test_naive_bayes_against_plain_counts(spark):
    sample = rows()
    model = langid.train(frame(spark))
    counts, docs = {}, Counter()
    for _, text, lang, *_ in sample:
        grams = langid.ngrams(text) if text else []
        if lang and len(grams):
            counts.setdefault(lang, np.zeros(langid.BUCKETS))
            np.add.at(counts[lang], grams, 1)
            docs[lang] += 1
    assert model.languages == tuple(sorted(counts))
    for j, lang in enumerate(model.languages):
        smooth = counts[lang] + 0.1
        assert np.allclose(model.log_prob[:, j], np.log(smooth / smooth.sum()), atol=1e-5)
        assert np.isclose(model.log_prior[j], np.log(docs[lang] / sum(docs.values())))
    found = langid.predict(frame(spark), model).collect()
    assert len(found) == len(sample)
    known = {r[0]: r[1] for r in sample}
    for r in found:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in known[r.doc_id] or ""))
    assert langid.known_language(frame(spark), model).count() == sum(r.lang_pred != "und" for r in found)


def test_language_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = op7_language(spark, sf_dir).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_untrained_models(spark):
    model = langid.train(empty(spark))
    assert {r.lang_pred for r in langid.predict(frame(spark), model).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(frame(spark), none).collect()} == {0.5}
    assert quality.quality_scores(empty(spark), none).count() == 0


def test_context_vectors_against_plain_sums(spark):
    texts = [r[1] or "" for r in rows()]
    places, signs = quality._index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIM))
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = quality.words(raw, np.array([0, len(raw)]))
        for i in range(len(ids)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    np.add.at(total[ids[i]], places[ids[j]], signs[ids[j]])
        if len(ids) > 2000:
            continue
    expected = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.context_vectors(frame(spark)), expected, atol=1e-5)


def test_quality_on_held_out_documents(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = op10_quality(spark, d)
    assert found.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    rows_ = found.join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows_ if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows_)


def test_awkward_rows_are_scored(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    found = quality.quality_scores(frame(spark), labels)
    assert found.count() == len(rows()) and found.where(F.col("score").isNull() | F.isnan("score")).count() == 0


def test_rows_at_the_driver_are_bounded_with_repeated_ids(spark, monkeypatch):
    """Three ids of 2,000 rows each and ``max_rows`` of 1: two rows are learned from, and equal rows are one."""
    met = []
    monkeypatch.setattr(quality, "fit_network", lambda x, y: met.append((x, y)))
    texts = spark.range(6000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text number "), (F.col("id") / 2).cast("int").cast("string")).alias("text"))
    features = quality.pooled(texts, np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    quality.train(features, labels, max_rows=1)
    quality.train(features, labels, max_rows=500)
    quality.train(features, labels, max_rows=10**6)
    assert [len(y) for _, y in met][:2] == [2, 1000] and len(met[2][1]) == features.distinct().count()
    assert sorted(met[0][1]) == [0, 1] and met[1][1].sum() == 500


def test_more_labels_than_the_bound_are_named(spark):
    docs = spark.createDataFrame([(i, f"text of {i}", f"l{i % 7}") for i in range(70)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5 labels.*l5, l6"):
        langid.train(docs, max_labels=5)
    assert len(langid.train(docs, max_labels=7).languages) == 7
