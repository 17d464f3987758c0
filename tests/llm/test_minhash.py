from __future__ import annotations

import random

import corpus_pipeline
from evidentry.llm import minhash
from tests.llm.samples import SCHEMA, WORDS, empty, frame


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_kept(docs):
    """docs: (doc_id, text) with distinct ids -> the smallest id of each component of all pairs at 0.8 or more."""
    sets = [slow_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * both > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(d for (d, _), g in zip(docs, group) if g == name) for name in set(group))


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_edited_copies_go_and_loose_ones_stay(spark):
    rng = random.Random(8)
    docs = []
    for k in range(30):
        base = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(rng.choice([60, 200, 600]))]
        for n in (0, 1, len(base) // 60, len(base) // 40, len(base) // 15):
            docs.append((len(docs), edited(rng, base, n)))
    table = spark.createDataFrame([(d, t, "en", "", 0, "", "", "") for d, t in docs], SCHEMA).repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect())
    assert kept == slow_kept(docs)
    assert len(kept) < len(docs) / 2


def test_links_that_pass_by_the_first_member(spark):
    """A chain of edits: its ends are far apart, so that no one member is near to all."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(0, " ".join(words))]
    for k in range(1, 60):
        words[rng.randrange(len(words))] = f"new{k}"
        docs.append((k, " ".join(words)))
    table = spark.createDataFrame([(d, t, "en", "", 0, "", "", "") for d, t in docs], SCHEMA)
    assert [r.doc_id for r in minhash.without_near_copies(table).collect()] == slow_kept(docs) == [0]


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = sorted(r.doc_id for r in minhash.without_near_copies(docs).collect())
    assert kept == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows_and_empty(spark):
    kept = minhash.without_near_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([d for d in ids if d in (100, 101, 102)]) == 1 and ids.count(107) == 0 and ids.count(None) == 1
    assert minhash.without_near_copies(empty(spark)).count() == 0


def test_texts_that_are_loosely_alike_are_not_compared_all_with_all(spark):
    """Copies of one text with a seventh of its words changed: near to 0.8 with it, and below with each other."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    docs = [(0, " ".join(base))] + [(i, edited(rng, base, rng.choice([4, 7, 9, 12, 20]))) for i in range(1, 120)]
    table = spark.createDataFrame([(d, t, "en", "", 0, "", "", "") for d, t in docs], SCHEMA)
    assert sorted(r.doc_id for r in minhash.without_near_copies(table).collect()) == slow_kept(docs)
    rows = [(d, [int(x) for x in minhash.shingles(t).view("int64")]) for d, t in docs]
    sets = spark.createDataFrame(rows, "set_hash long, shingles array<long>")
    rest = sets.selectExpr("set_hash", "size(shingles) AS n", "set_hash AS root")
    found = {(r.a, r.b) for r in minhash.prefix_pairs(rest, sets, 0.8).collect()}
    kept = dict(docs)
    alike = {(i, j) for j in kept for i in range(j) if (x := slow_set(kept[i])) and (y := slow_set(kept[j])) and len(x & y) >= 0.8 * len(x | y)}
    assert alike <= found and len(found) < len(docs) * (len(docs) - 1) / 2
