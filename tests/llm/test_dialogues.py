from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

from pyspark.sql import functions as F

from evidentry.llm import dialogues, queries

ROWS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def brute(rows):
    """(cost, audit) of rows (initial, gone, truncated) by trying every edit of every row with up to two inserts between."""
    gaps = [("", "")] + [("I" * len(x), x) for x in ("u", "a", "ua", "au")]
    choices = []
    for initial, gone, cut in rows:
        ways = [("D", "", 2)]
        if not gone:
            more = 5 if cut else 0
            ways += [("K", initial or "?", more), ("R", "u", 1 + more), ("R", "a", 1 + more)]
        choices.append(ways)
    best = None
    for gap in product(gaps, repeat=len(rows) + 1):
        inserted = sum(5 * len(g[0]) for g in gap)
        if best and inserted > best[0]:
            continue
        for ways in product(*choices):
            roles = gap[0][1] + "".join(w[1] + g[1] for w, g in zip(ways, gap[1:]))
            if GRAMMAR.fullmatch(roles):
                way = inserted + sum(w[2] for w in ways), gap[0][0] + "".join(w[0] + g[0] for w, g in zip(ways, gap[1:]))
                best = min(best, way) if best else way
    return best


def symbol(initial, gone, cut):
    x = initial if initial in ("s", "u", "a") else "o"
    return "x" if gone else x.upper() if cut else x


def test_walk_against_all_edits():
    rng = random.Random(2)
    shapes = [[], [("s", False, False)], [("u", False, True), ("a", False, True)]]
    shapes += [[(rng.choice(["s", "u", "a", "u", "a", "", "t"]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 3))] for _ in range(60)]
    shapes += [[(rng.choice("sua"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(4)] for _ in range(4)]
    for rows in shapes:
        assert dialogues.least_edits("".join(symbol(*r) for r in rows)) == brute(rows), rows


def whole(symbols):
    """The walk without blocks: whole audits are carried."""
    layer = [(0, 0, ""), None, None, None]
    for x in symbols:
        layer = dialogues._stepped(dialogues._closed(layer), x)
    layer = dialogues._closed(layer)
    cost, _, audit = min(w for w in (layer[0], layer[3]) if w)
    return cost, audit


def test_blocks_change_nothing():
    rng = random.Random(4)
    for letters in ("suaoSUAOx", "u", "ux", "uU", "ua", "sx", "aU", "x"):
        for n in (63, 64, 65, 128, 129, 700):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert dialogues.least_edits(text) == whole(text)


def plain(rows, ids):
    """The contract's rows, one conversation at a time."""
    out = []
    for conv in ids:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            key = ":".join(" " if x is None else str(x) for x in (c, turn))
            kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), fault == 2))
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = whole("".join(symbol(*m) for m in marks)) if marks else (0, "")
        lines, at, now = [], iter(mine), "n"
        for edit in audit:
            row = None if edit == "I" else next(at)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if now == "u" else "user"
            now = role[0]
            lines.append(f"{role}:{row[2] if row else ''}")
        out.append((str(conv), gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def made(seed=1):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And then", "", " \n\t", "Why? ", "été 日本.", "Yes.", None, "a\nb.", "long " * 5000 + "end."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(0, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"Line {t % 90}.") for t in range(700)]  # one long conversation
    rows += [(101, 5, "user", "Same.")] * 4 + [(102, None, "user", "Z."), (102, None, "assistant", "A."), (102, 3, "user", "B.")]
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "I."), (None, None, None, None), (103, -4, "system", "S."), (103, 9, "user", "U.")]
    return rows


def test_query_rows_against_a_plain_walk(spark, sf_dir):
    rows = made()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], ROWS + ", audit int, same int").repartition(5)
    assert found(dialogues.described(dialogues.damaged(df), df)) == plain(rows, {r[0] for r in rows})
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_dialogues(spark, sf_dir)) == plain(table, {r[0] for r in table})


def test_repaired_rows_follow_the_grammar(spark):
    df = spark.createDataFrame(made(7), ROWS).repartition(4)
    told = dialogues.reports(df)
    rows = dialogues.repaired_rows(df, told).orderBy("conv_id", "position").collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append(r)
    audits = {r.conv_id: r.audit for r in told.collect()}
    assert set(by_conv) == {c for c, a in audits.items() if a.strip("D")}
    for conv, mine in by_conv.items():
        assert GRAMMAR.fullmatch("".join(r.role[:1] for r in mine))
        assert "".join(r.edit for r in mine) == audits[conv].replace("D", "")
        assert [r.position for r in mine] == list(range(len(mine)))
        assert all((r.turn is None and r.text == "") for r in mine if r.edit == "I")


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert dialogues.described(dialogues.damaged(none), none).count() == 0
    ids = spark.range(3).select(F.col("id").alias("conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(dialogues.described(none, ids)) == [(str(i), 0, 0, 0, 0, 0, 0, "", nothing) for i in range(3)]
