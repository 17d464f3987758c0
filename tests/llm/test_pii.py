from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from evidentry.llm import pii
from evidentry.llm.queries import op2_pii
from tests.llm.samples import SCHEMA, empty, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def slow_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def test_base_spans_on_noise():
    rng = random.Random(4)
    parts = ["a", "B.c", "@", "..", "1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111", "x@y.z", "10.0.0.1", "0010.000.1.2", "+1 (499) 555-6503", "%", "é", "\n", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == slow_spans(text), text
    for text in ("1" * 5000, "a" * 5000 + "@", "1." * 3000, "+1" * 3000, "a@b.c" * 500, ""):
        assert pii.base_spans(text) == slow_spans(text)


def test_query_on_driver_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op2_pii(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = slow_spans(texts[r.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(i, f"filler text please call me at +1 (499) 555-{6000 + i} today thanks", "en", "", 0, "", "", "") for i in range(30)]
    hidden = [(50, "other words call me at 0171-555-0192 today or later", "en", "", 0, "", "", "")]
    clean = [(60 + i, f"shipment number 48291{i:04d}7 weighs {i} tons and costs 12.50", "en", "", 0, "", "", "") for i in range(30)]
    docs = spark.createDataFrame(seeds + hidden + clean, SCHEMA)
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    text = hidden[0][1]
    assert [(s.kind, text[s.start : s.end]) for s in found[50].more] == [("phone", "0171-555-0192")]
    assert not any(found[d].more or found[d].base for d in range(60, 90))


def test_masking_keeps_rows_and_columns(spark):
    docs = frame(spark).union(spark.createDataFrame([(200, "write to me@here.org or +1 (499) 555-6503.", "en", "", 0, "", "", "")], SCHEMA))
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 200").first().text == "write to <email> or <phone>."
    assert out.where("text IS NULL").count() == 1


def test_empty_and_awkward(spark):
    assert pii.personal_data(empty(spark)).count() == 0
    found = pii.personal_data(frame(spark))
    assert found.count() == frame(spark).count()
    assert found.where(F.size("base") > 0).count() == 0
