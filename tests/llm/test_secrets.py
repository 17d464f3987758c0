from __future__ import annotations

import hashlib
import random
import re

from evidentry.llm import secrets
from evidentry.llm.queries import op6_secrets
from tests.llm.samples import SCHEMA, empty, frame

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def python_spans(text, rules=secrets.BASE_RULES + secrets.MORE_RULES):
    """One regex after the other."""
    found = ((m, order, rule) for order, rule in enumerate(rules) for m in re.finditer(rule.pattern, text or "", re.ASCII))
    return sorted((m.start(), order, rule.kind, m.end()) for m, order, rule in found if len(m.group(rule.group)) >= rule.least)


def noise(n=400, seed=6):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "secret", "ToKeN", "api_key", "APIKEY", "\"", "'", " ", ":", "=", "abc123def456", "/x.y=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "f", "é", "\n", "ſecret", "toKen", "token=password: abcdefghijklmno", "ghp_" + "a1" * 18]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_spans_on_noise(spark):
    texts = noise() + [None, "", "x" * 50_000 + "token = abcdefghijklmnop"]
    docs = spark.createDataFrame([(i, t, None, "", 0, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.secret_spans(docs).collect()}
    for i, text in enumerate(texts):
        assert found[i] == python_spans(text), text
        assert [s for s in found[i] if s[1] < 3] == slow_base(text), text


def test_many_matches_in_one_text(spark):
    """More matches than a part of the walk holds."""
    texts = ["token=abcdefghijklmnop short=1 " * n + "0123456789abcdef" for n in (255, 256, 257, 700)]
    docs = spark.createDataFrame([(i, t, None, "", 0, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    for r in secrets.secret_spans(docs).collect():
        assert [tuple(s) for s in r.spans] == python_spans(texts[r.doc_id])


def test_query_on_driver_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op6_secrets(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        base = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
    assert any(r.spans for r in found)


def test_queries_are_mandatory():
    for rule in secrets.BASE_RULES + secrets.MORE_RULES:
        query = secrets.trigram_query(rule.pattern)

        def holds(q, text):
            return q is True or (q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, text) for x in q[1]))

        for text in noise(3000, 8):
            if re.search(rule.pattern, text, re.ASCII):
                assert holds(query, text.lower()), (rule.kind, text)
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("ab|abcd") is True
    assert secrets.trigram_query("(abcd|xyz)+q?") == ("or", (("and", ("abc", "bcd")), "xyz"))


def test_repeated_and_null_ids(spark):
    found = secrets.secret_spans(frame(spark))
    assert found.count() == frame(spark).count()
    docs = spark.createDataFrame([(None, "token=abcdefghijklmnop", *[None] * 2, 0, "", "", ""), (None, "clean", *[None] * 2, 0, "", "", ""), (1, "token=abcdefghijklmnop", *[None] * 2, 0, "", "", ""), (1, "other", *[None] * 2, 0, "", "", "")], SCHEMA)
    assert sorted(len(r.spans) for r in secrets.secret_spans(docs).collect()) == [0, 0, 1, 1]
    assert secrets.secret_spans(empty(spark)).count() == 0
