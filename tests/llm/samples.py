"""Small tables with every awkward row, and plain re-statements of the operators to test against."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, fp string, row int, shard string, text_hash string, code string"
WORDS = "the quick brown fox jumps over lazy dog while seven silver trains wait for rain near old harbour town and no one sees them go by night".split()


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 120))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        text = rng.choice(base)
        if i % 5 == 0:
            parts = text.split()
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        out.append((i, text, rng.choice(["en", "fr", None])))
    out += [
        (100, None, "en"),
        (101, "", "en"),
        (102, " \n\t ", None),
        (103, "one", "en"),
        (104, "Two Words", "en"),
        (105, "été Ünïcode ñandú ΣΑΣ 日本語 😀 text", "es"),
        (106, "word " * 9000, "en"),
        (107, base[0], "en"),
        (107, base[0], "en"),
        (107, base[1], "en"),
        (None, base[0], "en"),
        (None, "lonely text without an id", None),
        (108, "123 456 !!! ###", None),
        (109, "a.b-c_d\x00e\x7ff", "en"),
    ]
    return [(d, t, g, "x", 7, "s", "h", "c") for d, t, g in out]


def frame(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
