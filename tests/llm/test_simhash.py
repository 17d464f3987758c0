from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from evidentry.llm import simhash
from evidentry.llm.components import component_roots
from tests.llm.samples import empty, frame, rows


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, distance=3):
    """fps: list of (doc_id, fingerprint) -> list of component ids."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= distance:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    roots = [root(i) for i in range(len(fps))]
    least = {}
    for (doc, _), r in zip(fps, roots):
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [least.get(r) for r in roots]


def test_against_all_pairs(spark):
    sample = rows()
    fps = [(r[0], slow_fingerprint(r[1])) for r in sample]
    expected = sorted((str(d), f"{f:016x}", c) for (d, f), c in zip(fps, slow_components(fps)))
    found = simhash.near_duplicates(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = docs.select("doc_id", "text").collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in sample]
    expected = sorted((d, f"{f:016x}", c) for (d, f), c in zip(fps, slow_components(fps)))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected


def chain(n=400, seed=3):
    rng = random.Random(seed)
    values, at = set(), rng.getrandbits(64)
    while len(values) < n:
        values.add(at)
        for _ in range(rng.randint(1, 4)):
            at ^= 1 << rng.randrange(20)
    return [v - (1 << 64) if v >> 63 else v for v in values]


def test_large_buckets_keep_every_link(spark):
    values = chain()
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = slow_components([(v, v & (1 << 64) - 1) for v in values])
    for limit in (20_000, 5):
        links = simhash.fingerprint_links(distinct, max_bucket=limit)
        roots = {r.node: r.root for r in component_roots(links).collect()}
        assert [roots.get(v, v) for v in values] == expected, limit


def both_ways(spark, values):
    """The components by small buckets and by the way of large ones."""
    distinct = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    out = []
    for limit in (20_000, 1):
        roots = {r.node: r.root for r in component_roots(simhash.fingerprint_links(distinct, max_bucket=limit)).collect()}
        out.append({v: roots.get(s, s) % (1 << 64) for v, s in ((v, v - (1 << 64) if v >> 63 else v) for v in values)})
    return out


def test_each_bit_counts_alike(spark):
    """Pairs at 1 to 4 bits, each of the 64 bits flipped, are linked up to 3 and never at 4."""
    rng = random.Random(5)
    pairs, values = [], []
    for bit in range(64):
        for distance in (1, 2, 3, 4):
            base = rng.getrandbits(64)
            others = rng.sample([b for b in range(64) if b != bit], distance - 1)
            pairs.append((base, base ^ sum(1 << b for b in [bit, *others]), distance))
            values += pairs[-1][:2]
    expected = slow_components([(v, v) for v in values])
    for found in both_ways(spark, values):
        assert all((found[a] == found[b]) == (d <= 3) for a, b, d in pairs)
        assert len(set(found.values())) == len(set(expected))


def test_values_that_share_half_their_bits_are_not_linked(spark):
    for found in both_ways(spark, [0x00000000FFFFFFFF, 0xFFFFFFFFFFFFFFFF, 0x12345678, 0x8000000012345679]):
        assert found[0x00000000FFFFFFFF] != found[0xFFFFFFFFFFFFFFFF] and found[0x12345678] == found[0x8000000012345679]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    found = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}


def test_one_of_each_group_stays(spark):
    kept = simhash.without_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    named = frame(spark).withColumnsRenamed({"shard": "kept_id", "code": "group_id"})
    assert simhash.without_near_duplicates(named).count() == kept.count()
    groups = simhash.near_duplicates(frame(spark)).select("group_id").distinct().count()
    assert kept.count() == groups


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.without_near_duplicates(empty(spark)).count() == 0


def test_a_bucket_of_fifty_thousand_is_cut_again(spark):
    """All share 32 bits; pairs are planted at 1 to 4 bits. Each member is dealt to 20 finer buckets, not to every choice of 3 bits."""
    rng = np.random.default_rng(9)
    low = rng.choice(1 << 32, 49_600, replace=False).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(32, 1 + k % 4, replace=False)) for k in range(400)], np.uint64)
    values = np.unique(np.r_[low, low[:400] ^ flips]) | np.uint64(0xABCD_EF01 << 32)
    signed = values.view(np.int64)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in signed], "fp long").repartition(4))
    roots = {r.node: r.root for r in component_roots(links).collect()}
    planted = [((x | np.uint64(0xABCD_EF01 << 32)).view(np.int64), (x ^ f | np.uint64(0xABCD_EF01 << 32)).view(np.int64), int(np.bitwise_count(f))) for x, f in zip(low[:400], flips)]
    assert all(roots.get(int(a), int(a)) == roots.get(int(b), int(b)) for a, b, d in planted if d <= 3)
    pairs = links.collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in pairs)
    masks = simhash.block_masks(6, 3)
    for m in masks:
        known = m & (1 << 64) - 1
        finer = simhash.block_masks(6, 3, m)
        assert len(finer) == 20 and all((f & known) == known for f in (x & (1 << 64) - 1 for x in finer))
