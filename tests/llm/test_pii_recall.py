"""Recall and precision of discovered identifiers on planted contexts, with the default parameters."""

from __future__ import annotations

import random

import pytest

from evidentry.llm import pii

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def planted(share: float, after: bool, seed: int, n: int = 3000, contexts: int = 40):
    """(texts, unseen numbers' texts by document): phone numbers in shared contexts, ``share`` of them in a form that no fixed pattern has."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 9)))
    around = [(word(), word(), word()) for _ in range(contexts)]
    texts, unseen = [], {}
    for i in range(n):
        a, b, c = rng.choice(around)
        digits = f"{rng.randrange(10**9):09d}"
        shown = f"+49 {digits[:3]} {digits[3:]}"
        if rng.random() < share:
            shown = f"0{digits[:3]}-{digits[3:]}"
            unseen[i] = shown
        texts.append(f"{word()} {word()} {a} {b} {shown} {c if after else word()} {word()}")
    return texts, unseen


def noise(seed: int, n: int = 1500):
    """Numbers that are nobody's: in contexts of their own, in contexts with a few phone numbers among very many, beside cards, and long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 9)))
    out = [f"{word()} our order number {rng.randrange(10**8, 10**9)} {word()}" for _ in range(n)]
    out += [f"{word()} part of list {rng.randrange(10**7, 10**10)} {word()}" for _ in range(n)]
    out += [f"{word()} part of list +49 170 {rng.randrange(10**6, 10**7)} {word()}" for _ in range(30)]
    out += [f"{word()} file under serial {rng.randrange(10**19, 10**20)} {word()}" for _ in range(n // 4)]
    out += [f"{word()} file under serial +49 171 {rng.randrange(10**6, 10**7)} {word()}" for _ in range(10)]
    return out


@pytest.mark.parametrize("after", [False, True])
def test_recall_and_precision_at_many_unseen_shares(spark, after):
    rows, wanted = [], {}
    for k, share in enumerate((0.05, 0.2, 0.3, 0.5, 0.7)):
        texts, unseen = planted(share, after, seed=10 * k + after)
        wanted[share] = {len(rows) + i: v for i, v in unseen.items()}
        rows += texts
    rows += noise(3)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    more = {r.doc_id: [(s.kind, rows[r.doc_id][s.start : s.end]) for s in r.more] for r in pii.personal_data(docs).where("size(more) > 0").collect()}
    for share, unseen in wanted.items():
        hit = sum(("phone", v) in more.get(i, []) for i, v in unseen.items())
        assert hit >= 0.9 * len(unseen), (share, hit, len(unseen))
    right = {i: v for unseen in wanted.values() for i, v in unseen.items()}
    given = [(i, s) for i, found in more.items() for s in found]
    assert sum(right.get(i) == v and k == "phone" for i, (k, v) in given) >= 0.95 * len(given)


def test_words_at_any_distance_and_long_words():
    text = "call" + " " * 5000 + "me" + "\n" * 9000 + "5551234567" + " " * 4000 + "now " + "x" * 5000 + " then 5551234568 " + "y" * 5000 + "@ 5551234569"
    around = pii._Contexts(text)
    at = [(text.index(n), text.index(n) + 10) for n in ("5551234567", "5551234568", "5551234569")]
    assert [around.patterns(*x) for x in at] == [["call me _", "me _ now"], ["~ then _", "then _ ~"], ["# ~ _"]]


def test_near_and_far_words_agree():
    rng = random.Random(8)
    parts = ["word", "a", ",", "12", "x@y", " ", "  ", "\n", " " * 60, "z" * 99, "é", "(", ")", "q" * 101]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        start = rng.randrange(len(text))
        end = rng.randint(start + 1, len(text))
        near, far = pii._Contexts(text, near=rng.choice([1, 7, 240])), pii._Contexts(text, near=0)
        far._around = far._far
        assert near.patterns(start, end) == far.patterns(start, end), (text, start, end)
