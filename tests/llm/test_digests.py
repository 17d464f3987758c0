from __future__ import annotations

import hashlib

import numpy as np

from evidentry.llm import digests
from tests.llm.samples import empty, frame, rows


def slow_digest(data):
    counts = [0] * digests.BUCKETS
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
        h ^= h >> 15
        counts[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 24] += 1
    quarter = sorted(counts)[len(counts) // 4 - 1 :: len(counts) // 4][:3]
    return [sum(c > q for q in quarter) for c in counts]


def test_digest_against_plain_counts():
    for _, text, *_ in rows()[:70]:
        raw = (text or "").encode()
        packed = bytes.fromhex(digests.digest(raw))[2:]
        assert [p >> s & 3 for p in packed for s in (6, 4, 2, 0)] == slow_digest(raw)


def plain(texts):
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1] or ""
        text = text or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        own, mark, theirs = (digests.digest(x.encode()) for x in (text, new, after))
        out.append((str(doc), len(text), hashlib.sha256(new.encode()).hexdigest(), own, mark, digests.likeness(own, mark), digests.likeness(own, theirs)))
    return sorted(out)


def test_against_a_sorted_list(spark, sf_dir):
    found = digests.compared_with_next(frame(spark)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == plain([(r[0], r[1]) for r in rows()])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = digests.compared_with_next(docs.repartition(7)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    better = np.mean([(a.near_edited > b.near_next) + 0.5 * (a.near_edited == b.near_next) for a in found for b in found])
    assert better > 0.95


def test_few_rows(spark):
    assert digests.compared_with_next(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert digests.compared_with_next(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    prints = {r.doc_id: r.fingerprint for r in digests.fingerprints(frame(spark)).collect()}
    assert prints[100] == prints[101]
