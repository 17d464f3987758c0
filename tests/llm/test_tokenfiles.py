from __future__ import annotations

import zlib

import numpy as np
import pytest

from evidentry.llm import tokenfiles
from evidentry.llm.tokenize import CachedTokenizer, default_path
from evidentry.session import scratch_path
from tests.llm.samples import empty, frame, rows


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 40_000), 50_000).astype(np.int64)
    counts = np.bincount(ids, minlength=50_257)
    coder = tokenfiles.Coder(tokenfiles.scaled(counts))
    for lanes, part in ((1, ids[:100]), (64, ids[:7]), (128, ids[:128]), (1024, ids), (32, ids[:0])):
        frame_ = coder.encode(part, lanes)
        assert coder.decode(frame_).tolist() == part.tolist()
    assert len(coder.encode(ids, 16)) < 2 * len(ids)
    one = tokenfiles.Coder(tokenfiles.scaled(np.array([0, 9])))
    assert one.decode(one.encode(np.ones(50, np.int64), 4)).tolist() == [1] * 50


def test_segments_are_decoded_from_their_checkpoints_in_any_order():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 900, 10_001)
    coder = tokenfiles.Coder(tokenfiles.scaled(np.bincount(ids)))
    for lanes, every in ((16, 10), (64, 1), (1, 700), (4096, 2)):
        raw = coder.encode(ids, lanes, every)
        size = lanes * every
        count = -(-len(ids) // size)
        for k in reversed(range(count)):
            assert next(coder.segments(raw, [k])).tolist() == ids[k * size : (k + 1) * size].tolist()
        assert coder.decode(raw).tolist() == ids.tolist()
    assert coder.encode(ids, 16, 10) != coder.encode(ids, 16, 20)


def test_a_document_of_many_segments(spark):
    rng = np.random.default_rng(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta."], 30_000))
    texts = [(1, "short"), (2, long), (2, long), (3, None)]
    folder = scratch_path(spark, "t")
    tokenfiles.write_token_files(spark.createDataFrame(texts, "doc_id long, text string"), folder, shards=2, lanes=32, block_tokens=1000)
    for keep in (True, False):
        found = tokenfiles.read_token_files(spark, folder, keep_ids=keep).collect()
        assert sorted(tuple(r)[:4] for r in found) == expected(texts)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in tokenfiles.read_token_files(spark, folder).collect())


def test_scaled_keeps_every_symbol():
    counts = np.r_[np.ones(50_000, np.int64), 10**12, 0]
    found = tokenfiles.scaled(counts)
    assert found.sum() == 1 << tokenfiles.SCALE_BITS and found[:-1].min() == 1 and found[-1] == 0


def test_damage_is_found():
    coder = tokenfiles.Coder(tokenfiles.scaled(np.array([5, 3, 2])))
    raw = bytearray(coder.encode(np.array([0, 1, 2, 0, 1] * 20), 4))
    raw[-3] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(raw))


def expected(texts, end=2):
    tok = CachedTokenizer(default_path("byte_bpe_50k.json")).tokenizer
    out, start = [], 0
    for doc, text in texts:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "t")
    tokenfiles.write_token_files(docs, folder, shards=5, lanes=64, block_tokens=5000)
    found = sorted(tuple(r)[:4] for r in tokenfiles.read_token_files(spark, folder).collect())
    assert found == expected(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert spark.read.parquet(f"{folder}/blocks").count() > 5


def test_awkward_rows_and_empty(spark):
    folder = scratch_path(spark, "t")
    tokenfiles.write_token_files(frame(spark), folder, shards=3, lanes=16)
    found = tokenfiles.read_token_files(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(d), n, c) for d, _, n, c in expected([(r[0], r[1]) for r in rows()]))
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32
    folder = scratch_path(spark, "t")
    tokenfiles.write_token_files(empty(spark), folder)
    assert tokenfiles.read_token_files(spark, folder).count() == 0


def test_checksums_are_put_together():
    rng = np.random.default_rng(6)
    for n, m in ((0, 0), (5, 0), (0, 7), (1, 1), (1000, 77), (3, 100_000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert tokenfiles.joined_crc32(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_a_full_block_has_eight_segments_in_rows_of_their_own(spark):
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 300, (1 << 21) + 5).astype(np.uint16)
    coder = tokenfiles.Coder(tokenfiles.scaled(np.bincount(ids)))
    frames = list(coder.cut(coder.encode(ids[: 1 << 21], 2048, 128)))
    assert len(frames) == 8
    for k in reversed(range(8)):
        assert (coder.decode(frames[k]) == ids[k << 18 : k + 1 << 18]).all()
    damaged = bytearray(frames[3])
    damaged[60] ^= 4
    with pytest.raises(ValueError):
        coder.decode(bytes(damaged))
    text = " ".join(rng.choice(["alpha", "beta", "gamma"], 3000))
    folder = scratch_path(spark, "t")
    tokenfiles.write_token_files(spark.createDataFrame([(1, text), (2, "x"), (3, text)], "doc_id long, text string"), folder, shards=1, lanes=16, steps=8, block_tokens=100_000)
    rows_ = spark.read.parquet(f"{folder}/blocks").orderBy("first_token").collect()
    assert len(rows_) > 40 and {r.block for r in rows_} == {0}
    assert [r.first_token for r in rows_] == list(range(0, 128 * len(rows_), 128))


def test_shards_follow_the_ids(spark):
    texts = [(i, "one two three four") for i in range(40)]
    folder = scratch_path(spark, "t")
    tokenfiles.write_token_files(spark.createDataFrame(texts, "doc_id long, text string"), folder, lanes=4, shard_tokens=10)
    assert spark.read.parquet(f"{folder}/blocks").select("shard").distinct().count() > 10
    assert sorted(tuple(r)[:4] for r in tokenfiles.read_token_files(spark, folder).collect()) == expected(texts)


def test_more_symbols_than_places_are_refused():
    with pytest.raises(ValueError, match="no place"):
        tokenfiles.scaled(np.ones(9, np.int64), bits=3)
