from __future__ import annotations

from evidentry.llm import columns
from evidentry.llm.columns import key_filter, kept, pieces
from pyspark.sql import functions as F


def test_a_worker_keeps_one_table_until_it_idles(monkeypatch):
    now, made = [100.0], []
    monkeypatch.setattr(columns.time, "monotonic", lambda: now[0])
    monkeypatch.setattr(columns, "_kept", {})
    make = lambda name: lambda: made.append(name) or name
    assert [kept(("a",), make("a")), kept(("a",), make("a"))] == ["a", "a"] and made == ["a"]
    now[0] += columns.IDLE_S - 1
    assert list(pieces(iter([]))) == [] and kept(("a",), make("a")) == "a" and made == ["a"]
    now[0] += columns.IDLE_S + 1
    assert list(pieces(iter([]))) == [] and not columns._kept
    kept(("a",), make("a")), kept(("b",), make("b"))
    assert made == ["a", "a", "b"] and list(columns._kept) == [("b",)]


def test_key_filter_never_leaves_a_key_out(spark, monkeypatch):
    keys = spark.createDataFrame([(i * 7, f"h{i}") for i in range(500)] + [(None, "x"), (3, None)], "id long, h string")
    rows = spark.range(20_000).select("id", F.concat(F.lit("h"), (F.col("id") / 7).cast("int").cast("string")).alias("h")).union(keys)
    named = lambda df: F.struct("id", "h")
    found = rows.where(key_filter(keys, named(keys), named(rows), 502))
    assert found.join(keys, found["id"].eqNullSafe(keys["id"]) & found["h"].eqNullSafe(keys["h"]), "left_semi").count() == 1002
    assert found.count() < 2600  # of 20,502
    monkeypatch.setattr(columns, "MOST_BITS", 64)  # too few bits: more rows pass, none is missing
    assert rows.where(key_filter(keys, named(keys), named(rows), 502)).join(keys, ["id", "h"], "left_semi").count() == 1000
