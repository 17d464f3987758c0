"""Texts of up to a megabyte without a blank, or with many matches, pass every operator in a time that is linear in them."""

from __future__ import annotations

import time

import pytest

from evidentry.llm import decontam, digests, langid, minhash, packing, pii, quality, secrets, sharding, simhash, tokenfiles
from evidentry.session import scratch_path

SIZE = 1_000_000
TEXTS = {
    "letters": "abcdefghij" * (SIZE // 10),
    "digits": "1" * SIZE,
    "ideographs": "日本語" * (SIZE // 9),
    "addresses": "10.0.0.1 " * (SIZE // 18),
    "ats": "a@" * (SIZE // 4),
    "emails": "a@b.co," * (SIZE // 14),
    "marks": "(+).-" * (SIZE // 5),
    "phones": "+1 (499) 555-6503 " * (SIZE // 36),
    "tokens": "token=abcdefghijklmnop " * (SIZE // 46),
}


@pytest.mark.parametrize("name", TEXTS)
def test_personal_data_of_one_text_is_linear(name):
    began = time.time()
    text = TEXTS[name]
    base = pii.base_spans(text)
    list(pii._tokens(text))
    pii._number_runs(text, sorted((s, e) for _, s, e in base))
    assert time.time() - began < 20


def frame(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS.values())], "doc_id long, text string, lang string").repartition(4)


def token_files(docs):
    folder = scratch_path(docs.sparkSession, "long")
    tokenfiles.write_token_files(docs, folder)
    return tokenfiles.read_token_files(docs.sparkSession, folder, keep_ids=False)


OPERATORS = {
    "simhash": simhash.near_duplicates,
    "near_copies": minhash.near_copies,
    "pii": pii.personal_data,
    "masked": pii.masked,
    "packing": packing.pack,
    "token_files": token_files,
    "decontam": lambda docs: decontam.contaminated_words(docs, docs.sparkSession.createDataFrame([(1, "one two")], "item_id long, text string")),
    "secrets": secrets.secret_spans,
    "language": lambda docs: langid.predict(docs, langid.train(docs)),
    "digests": digests.compared_with_next,
    "sharding": sharding.shard_by_size,
    "quality": lambda docs: quality.quality_scores(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_on_long_texts(spark, name):
    began = time.time()
    found = OPERATORS[name](frame(spark)).collect()
    assert len({r.doc_id for r in found}) == len(TEXTS)
    assert time.time() - began < 120
