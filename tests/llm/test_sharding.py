from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np

from evidentry.llm import sharding
from tests.llm.samples import empty, frame, rows


def slow_best_fit(sizes, capacity):
    out, free = [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [f for f in free if f >= sizes[i]]
        if not fits or sizes[i] > capacity:
            out[i] = len(free)
            free.append(max(0, capacity - sizes[i]))
        else:
            tight = min(fits)
            out[i] = max(j for j, f in enumerate(free) if f == tight)
            free[out[i]] -= sizes[i]
    return out, free


def test_tree_finds_the_tightest_bin():
    rng = random.Random(3)
    for capacity in (1, 63, 64, 4097, 10**7):
        sizes = np.array([rng.randint(1, max(1, capacity // rng.choice([1, 3, 9]))) for _ in range(400)])
        bins, (_, free) = sharding.best_fit_decreasing(sizes, capacity), slow_best_fit(sizes.tolist(), capacity)
        filled = np.bincount(bins, sizes)
        assert sorted(capacity - filled.astype(int)) == sorted(free)


def check(found, texts):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())


def test_shards_of_near_equal_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sharding.shard_by_size(docs, shards=8, cell_groups=40).collect()
    check(found, [(r.doc_id, r.text) for r in docs.collect()])
    filled = np.bincount([r.shard for r in found], [r.size for r in found], 8)
    groups = defaultdict(int)
    for r in found:
        groups[r.text_crc32] += r.size
    assert filled.max() <= max(max(groups.values()), 1.02 * filled.mean())


def test_awkward_rows(spark):
    check(sharding.shard_by_size(frame(spark), shards=8).collect(), [(r[0], r[1]) for r in rows()])
    check(sharding.with_slots(sharding.shard_by_size(frame(spark), shards=3).drop("slot"), slice_rows=5).collect(), [(r[0], r[1]) for r in rows()])
    assert sharding.shard_by_size(empty(spark)).count() == 0


def test_fixed_capacity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sharding.shard_by_size(docs, shards=None, capacity=60_000).collect()
    check(found, [(r.doc_id, r.text) for r in docs.collect()])
    filled, groups = defaultdict(int), defaultdict(int)
    for r in found:
        filled[r.shard] += r.size
        groups[r.text_crc32] += r.size
    assert all(f <= 60_000 or f in groups.values() for f in filled.values())
    assert len(filled) <= sum(filled.values()) / 60_000 * 1.2 + 2


def test_a_hot_group_leaves_the_rest_balanced():
    sizes = np.array([1000, *[10] * 100])
    filled = np.bincount(sharding.balanced(sizes, 5), sizes, 5)
    assert filled.max() == 1000 and sorted(filled)[:4] == [250] * 4
