from __future__ import annotations

import hashlib
import re

from evidentry.llm import decontam
from evidentry.llm.queries import op5_decontam
from tests.llm.samples import SCHEMA, empty, frame, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((str(doc), len(w), sorted(hit), sorted(map(str, found))))
    return sorted(out)


def benchmark(spark):
    sample = rows()
    items = [(1, sample[0][1]), (2, "Two, words!"), (3, "one"), (4, None), (5, "..."), (6, " ".join(sample[5][1].split()[3:16])), (7, "word " * 12), (8, "ΣΑΣ 日本語 😀"), (2, "Two, words!")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_against_every_window(spark):
    items, bench = benchmark(spark)
    expected = slow([(r[0], r[1]) for r in rows()], items)
    for block in (8 << 20, 200):
        found = decontam.contaminated_words(frame(spark), bench, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, sorted(r.hits), list(r["items"])) for r in found) == expected, block


def test_query_on_driver_documents(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = [(d, n, len(h), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h)) for d, n, h, i in slow(texts, items)]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op5_decontam(spark, sf_dir).collect()) == expected
    assert any(e[-1] for e in expected)


def test_clean_rows_stay(spark):
    items, bench = benchmark(spark)
    kept = decontam.decontaminated(frame(spark), bench)
    assert kept.columns == frame(spark).columns
    clean = sorted(d for d, _, h, _ in slow([(r[0], r[1]) for r in rows()], items) if not h)
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_empty(spark):
    _, bench = benchmark(spark)
    assert decontam.contaminated_words(empty(spark), bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    found = decontam.contaminated_words(frame(spark), nothing).collect()
    assert len(found) == len(rows()) and not any(r.hits for r in found)
