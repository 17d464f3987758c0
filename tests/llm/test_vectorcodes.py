from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentry.llm import queries, vectorcodes

ROWS = "vec_id long, embedding array<float>, label int, codes string"


def plain(rows, parts=4, entries=256, rounds=4):
    """The codes by comparing every part with every entry, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def nearest(v, k):
        p = cut(v, k)
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        met = defaultdict(list)
        for _, v, _ in kept:
            for k in range(parts):
                met[k, nearest(v, k)[1]].append(cut(v, k))
        for (k, i), ps in met.items():
            books[k][i] = [sum(c) // len(ps) for c in zip(*ps)]
    out, by_label = [], Counter()
    for i, v, g in kept:
        found = [nearest(v, k) for k in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), g))
        by_label[g] += out[-1][2]
    return sorted((str(i), c, e, by_label[g]) for i, c, e, g in out)


def found(spark, rows, **how):
    codes, books = vectorcodes.compressed(spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(3), **how)
    return sorted((str(r.id), "".join(f"{c:02x}" for c in r.codes), r.error, r.label_error) for r in codes.collect()), books


def test_tree_against_all_entries():
    rng = np.random.default_rng(3)
    for trial in range(40):
        width, n, m = int(rng.integers(0, 9)), int(rng.integers(1, 260)), int(rng.integers(1, 200))
        top = int(rng.choice([1, 3, 400, 10**7, 3 * 10**8]))  # few values make many ties; the last is past exact doubles
        entries, points = rng.integers(-top, top + 1, (n, width)), rng.integers(-top, top + 1, (m, width))
        points[: m // 3] = entries[rng.integers(0, n, m // 3)]
        index, far = vectorcodes.VantageTree(entries).nearest(points)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points])
        assert (index == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()


def test_codes_against_all_comparisons(spark):
    rng = np.random.default_rng(5)
    value = lambda: float(np.float32(rng.choice([-0.5, 0.25, 0.0, 0.75]) if rng.random() < 0.5 else rng.normal()))
    rows = [(int(i), [value() for _ in range(8)], int(rng.integers(0, 3)) if i % 7 else None) for i in rng.permutation(400)]
    rows += [(7, rows[3][1], 1)] * 2 + [(None, rows[4][1], 2), (500, None, 1), (501, [None] * 8, 1), (502, [math.nan] * 8, 1), (503, [1.0] * 7 + [math.inf], 1), (504, [0.0] * 8, None)]
    rows += [(600 + i, rows[0][1], 9) for i in range(150)]  # copies
    for entries in (256, 20, 1000):
        codes, _ = found(spark, rows, entries=entries)
        assert codes == plain(rows, entries=entries)


def test_query_against_all_comparisons(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = queries.op11_vector_codes(spark, sf_dir).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out) == plain(rows)
    assert len({r.codebooks_sha256 for r in out}) == 1


def test_restored_vectors_have_the_error(spark):
    rows = [(i, [float(i % 5), float(i % 3), 0.5, -float(i)], 0) for i in range(40)]
    codes, books = vectorcodes.compressed(spark.createDataFrame([(*r, "x") for r in rows], ROWS), entries=8)
    back = {r.id: (r.restored, r.error) for r in vectorcodes.restored(codes, books).collect()}
    for i, v, _ in rows:
        assert sum((math.floor(1024 * x) - y) ** 2 for x, y in zip(v, back[i][0])) == back[i][1]


def test_awkward_tables(spark):
    assert found(spark, []) == ([], None)
    assert found(spark, [(1, None, 1), (2, [math.nan], 1)]) == ([], None)
    assert found(spark, [(1, [], 1), (2, [], None)])[0] == [("1", "00000000", 0, 0), ("2", "00000000", 0, 0)]
    with pytest.raises(Exception, match="one length"):
        found(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])
    with pytest.raises(Exception, match="one length"):
        found(spark, [(1, [1.0] * 6, 1)])
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(1, [1e30] * 4, 1)])
