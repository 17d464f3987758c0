from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evidentry.llm import packing
from evidentry.llm.tokenize import CachedTokenizer, default_path
from tests.llm.samples import empty, frame, rows

TEXTS = ["", "  a  b\n\n c ", "x\ty <|endoftext|> z", "IT'S İstanbul ΣΑΣ don't", "á é b 12345 $$$!!\n", "日本語 テスト", " lead", "trail \n", "a'll we'RE\x1cb", "one,two...three!!  four"]


def test_an_end_id_beyond_two_bytes_widens_the_ids():
    narrow, wide = (CachedTokenizer(default_path("byte_bpe_50k.json"), end) for end in (2, 70_000))
    assert (narrow.wide, wide.wide) == ("<u2", "<u4")
    texts = ["plain words.", "plain words.", "日本語"]
    assert [np.frombuffer(x, "<u2").tolist() for x in narrow.encode(texts)] == [np.frombuffer(x, "<u4").tolist() for x in wide.encode(texts)]


def test_copies_of_one_row_are_dealt_to_many_groups(spark):
    docs = spark.createDataFrame([(7, "the same row")] * 300, "doc_id long, text string")
    found = packing.pack(docs, group_size=50).collect()
    assert len(found) == 300 and len({r.sequence_id >> 32 for r in found}) > 3
    check_packing(found, [(7, "the same row")] * 300)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_cache_is_exact(name):
    cached = CachedTokenizer(default_path(name), limit=50)
    texts = TEXTS + [r[1] or "" for r in rows()]
    for _ in range(2):
        got = [np.frombuffer(x, cached.wide).tolist() for x in cached.encode(texts)]
        assert got == [e.ids for e in cached.tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packing(found, texts, capacity=2048):
    cached = CachedTokenizer(default_path("word_bpe_49k.json"))
    expected = []
    for doc, text in texts:
        ids = np.array(cached.tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((str(doc), k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_pieces_and_places(spark):
    check_packing(packing.pack(frame(spark)).collect(), [(r[0], r[1]) for r in rows()])
    assert packing.pack(empty(spark)).count() == 0


def test_driver_documents_fill_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = packing.pack(docs).collect()
    bins = check_packing(found, [(r.doc_id, r.text) for r in docs.collect()])
    lengths = sorted((r.length for r in found), reverse=True)
    free = []
    for n in lengths:  # plain best-fit decreasing
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=free.__getitem__)
            free[i] -= n
        else:
            free.append(2048 - n)
    assert math.ceil(sum(lengths) / 2048) <= len(bins) <= len(free) + 1


def test_every_capacity_binds():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 500)
    for by in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, 1000, 3, 200_000, (1, 1, 1), by)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert own.sum() <= 1000 and len(own) <= 3 and (own**2).sum() <= 200_000
            assert sorted(offsets[bins == b]) == sorted(np.r_[0, np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]])


def test_groups_of_any_size_give_whole_results(spark):
    found = packing.pack(frame(spark), group_size=10, keep_ids=True).collect()
    check_packing(found, [(r[0], r[1]) for r in rows()])
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in found)
