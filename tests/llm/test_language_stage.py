from __future__ import annotations

import corpus_pipeline
from tests.llm.samples import SCHEMA


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "some clean text", None, "", 0, "", "", ""), (2, "日本語", None, "", 0, "", "", ""), (3, "123 !!", None, "", 0, "", "", ""), (4, None, None, "", 0, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 2]
