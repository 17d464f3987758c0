from __future__ import annotations

import random

import pytest

from evidentry.llm import pii
from tests.llm.samples import SCHEMA

FORMS = ("(499) 555-6503", "499 555 6503", "499.555.6503", "(0499) 555 6503", "499 555-6503", "4111 1111 1111 1112", "4111-1111-1111-1112", "49 9555 65 03")


def test_unseen_numbers_in_each_spaced_form(spark):
    seeds = [(i, f"filler text please call me at +1 (499) 555-{6000 + i} today thanks", "en", "", 0, "", "", "") for i in range(60)]
    hidden = [(100 + k, f"other words call me at {form} today or later", "en", "", 0, "", "", "") for k, form in enumerate(FORMS)]
    clean = [(200 + i, f"shipment numbers 482 91{i:04d} 77 and 10.0.0.1 weigh {i} tons", "en", "", 0, "", "", "") for i in range(30)]
    docs = spark.createDataFrame(seeds + hidden + clean, SCHEMA)
    found = {r.doc_id: r.more for r in pii.personal_data(docs).collect()}
    for d, text, *_ in hidden:
        assert [(s.kind, text[s.start : s.end]) for s in found[d]] == [("phone", FORMS[d - 100])], text
    assert not any(found[d] for d in found if d >= 200)
    assert pii.masked(docs).where("doc_id = 101").first().text == "other words call me at <phone> today or later"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a 499 555 6503, b", ["499 555 6503"]),
        ("x12 3456789 v", ["3456789"]),
        ("12 3456789 0v", ["12 3456789"]),
        ("(0171 555 0192)", ["0171 555 0192"]),
        ("12,3456789", []),
        ("ab-5551234567", []),
        ("10.0.0.1 5551234567", ["5551234567"]),
        ("1 2 3", []),
    ],
)
def test_runs(text, expected):
    taken = sorted((s, e) for _, s, e in pii.base_spans(text))
    assert [text[s:e] for s, e in pii._number_runs(text, taken)] == expected


def test_runs_on_noise():
    rng = random.Random(5)
    parts = ["a", "@", "1", "2345678", "255", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "+1 (499) 555-6503", "é", "\n", ","]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        taken = sorted((s, e) for _, s, e in pii.base_spans(text))
        end = 0
        for s, e in pii._number_runs(text, taken):
            assert end <= s < e and sum(c.isdigit() for c in text[s:e]) >= 7, text
            assert not any(x < e and s < y for x, y in taken), text
            end = e


def test_chain_of_contexts_beyond_three_rounds(spark):
    """Each link's values stand in the context before and in the next one; only the first has seeds."""
    links, rows = 7, []
    for link in range(links + 1):
        for i in range(20):
            number = f"+1 (499) 555-{6000 + i}" if link == 0 else f"{link}71-555-{1000 + i}"
            for k in (link - 1, link):
                if k >= 0:
                    rows.append((len(rows), f"see lead word{chr(97 + k)} {number} tail{chr(97 + k)} end", "en", "", 0, "", "", ""))
    rows.append((900, f"see lead word{chr(97 + links)} 999 555 0000 tail{chr(97 + links)} end", "en", "", 0, "", "", ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    how = {"confidence": 0.4, "promote": 0.4}
    more = pii.personal_data(docs, **how).where("doc_id = 900").first().more
    assert [(s.kind, rows[-1][1][s.start : s.end]) for s in more] == [("phone", "999 555 0000")]
    assert not pii.personal_data(docs, rounds=3, **how).where("doc_id = 900").first().more
