from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentry.llm import queries, wordpieces
from tests.llm.samples import empty, frame, rows

PATH = wordpieces.default_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLE = wordpieces.WordTable(PATH, limit=50)
ALPHABET = [" ", "  ", "▁", "a", "the", "é", "日本", "😀", "\n", "\t", "\x00", "<s>", "</s>", "<0x41>", " ", "　", "ing", "1", ".", "﻿", "ﬁ", "́", "x" * 90]


def ids_of(raw):
    return memoryview(raw).cast("I").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join)), max_size=6))
def test_texts_as_the_library(texts):
    for text, raw in zip(texts, TABLE.encode(texts), strict=True):
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert ids_of(raw) == ids and TABLE.decode(raw) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 3, 35, 259, 28705]), st.integers(0, 31999)), max_size=9))
def test_any_ids_as_the_library(ids):
    assert TABLE.decode(struct.pack(f"<{len(ids)}I", *ids)) == LIBRARY.decode(ids)


def test_no_piece_of_this_model_reaches_over_markers():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(LIBRARY.serialized_model_proto())
    assert wordpieces.words_stand_alone(model)
    model.pieces[300].piece = "a▁b"
    assert not wordpieces.words_stand_alone(model)
    model.pieces[300].piece = "zz"
    model.normalizer_spec.remove_extra_whitespaces = True
    assert not wordpieces.words_stand_alone(model)


def test_whole_texts_where_words_do_not_stand_alone():
    table = wordpieces.WordTable(PATH)
    table.by_words = False
    texts = ["", " a  b ", "one two", "日本 x"]
    for text, raw in zip(texts, table.encode(texts)):
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert ids_of(raw) == ids and table.decode(raw) == LIBRARY.decode(ids)


def test_rows_stay_with_their_columns(spark):
    found = wordpieces.decoded(wordpieces.encoded(frame(spark))).collect()
    assert sorted((str(r.doc_id), r.text, r.lang or "", r.fp) for r in found) == sorted((str(d), t or "", g or "", "x") for d, t, g, *_ in rows())
    for r in found:
        assert ids_of(r.ids) == LIBRARY.encode(r.text, add_bos=True, add_eos=True)
    assert wordpieces.decoded(wordpieces.encoded(empty(spark))).count() == 0
    taken = spark.createDataFrame([(1, "a b", b"mine")], "doc_id long, text string, ids binary")
    assert bytes(wordpieces.encoded(taken).first()["_ids"]) == TABLE.encode(["a b"])[0]
    nulls = spark.createDataFrame([(None,)], "ids binary")
    assert wordpieces.decoded(nulls).first()["text"] == ""


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 200_000, "日" * 100_000, ("word " * 60_000).strip(), "".join(random.Random(1).choice("ab ▁é") for _ in range(200_000))])
def test_long_texts(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    raw = TABLE.encode([text])[0]
    assert ids_of(raw) == ids and TABLE.decode(raw) == LIBRARY.decode(ids)


def test_query_as_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op13_wordpieces(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
