"""What kept a query's time from growing with its input alone."""

from __future__ import annotations

import random
import shlex
import time

import pandas as pd
from pyspark.sql import functions as F

from evidentry.functions import texts
from evidentry.operators import rollups
from evidentry.operators.store import EvidenceStore
from evidentry.sources import formats, rawlines
from evidentry.streaming.records import Assembler


def test_tokens_are_named_in_the_pass_that_finds_them(spark):
    """One pass with marks gives what gaps and tokens asked one by one give, in a fraction of the time on prose; private characters are kept."""
    words = "Erreth was the, that 3.5s edouhe.\nOf x@b.org it's 10.0.0.1:80 deadbeef éa https://a.b/c \U0001d400deadbeef -x-y.z:1 <NUM>\t"
    rows = [(words * 400,), ("a\ue000 7",), ("",), (None,)]
    frame = spark.createDataFrame(rows, "m string").coalesce(1).cache()
    marks, parts = texts._by_marks(F.col("m")), texts._by_parts(F.col("m"))
    assert frame.where(~marks.eqNullSafe(parts)).count() == 1  # the one with private characters
    assert [r[0] for r in frame.where("m LIKE 'a%'").select(texts.mask("m")).collect()] == ["a\ue000 <NUM>"]
    prose = spark.createDataFrame([("Erreth was ofretihaou the that edouhe.\n" * 10000,)], "m string").cache()

    def seconds(column):
        prose.select(F.length(column)).collect()
        began = time.time()
        prose.select(F.length(column)).collect()
        return time.time() - began

    assert seconds(texts._by_marks(F.col("m"))) < seconds(texts._by_parts(F.col("m"))) / 2


def test_only_formats_that_were_found_are_parsed(spark):
    """Formats that no file has cost nothing, and plain pairs are what shlex gives."""

    def never(lines):
        raise AssertionError("no file has this format")

    kinds = (formats.LogFormat("never", lambda raw: F.lit(False), never), *(f for f in formats.FORMATS if f.name == "logfmt"))
    lines = spark.createDataFrame([("a.log", 0, 'ts=2026-01-01T00:00:00Z service=s msg="x y"')], "source_file string, source_offset long, raw string")
    services = spark.createDataFrame([(1, "s", "UTC")], "id int, name string, log_timezone string")
    assert [r.message for r in formats.drafts(lines, services, formats=kinds).collect()] == ["x y"]
    dice = random.Random(3)
    for _ in range(20000):
        line = "".join(dice.choice(["a", "=", " ", "  ", '"', "'", "b=1", 'c="x y"', "d=''", "\\", "#", " ", "\t", "\r"]) for _ in range(dice.randint(0, 9)))
        plain = formats._plain_pairs(line)
        if plain is not None:
            pairs = [t.split("=", 1) for t in shlex.split(line)]
            assert all(len(p) == 2 and p[0] for p in pairs) and plain == dict(pairs), line


def test_small_splits_share_tasks_and_are_read_once(spark, tmp_path, monkeypatch):
    """Splits of 64 KB are dealt to few tasks, and a split reads little beyond its own bytes."""
    body = b"".join(b"%d:" % i + b"x" * (i % 90) + b"\n" for i in range(60000))
    (tmp_path / "a.log").write_bytes(body)
    found = rawlines.read_lines(spark, str(tmp_path), split_bytes=1 << 16)
    assert found.rdd.getNumPartitions() == 1 and found.count() == 60000
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, size, at):
            read.append(size)
            return self.file.read_at(size, at)

    class System:
        def open_input_file(self, name):
            return Counted(rawlines.fs.LocalFileSystem().open_input_file(name))

    monkeypatch.setattr(rawlines, "_opened", lambda path: (System(), path))
    splits = rawlines._splits(str(tmp_path / "a.log"), 0, len(body), 1 << 16)
    given = [line for s in splits for batch in rawlines.lines_of(s) for line in batch.column(2).to_pylist()]
    assert b"".join(x + b"\n" for x in given) == body
    assert sum(read) < 3 * len(body)


def test_a_batch_of_records_asks_state_a_few_times():
    """However many records a micro-batch has, the calls of state are as many."""
    calls = []

    class Value:
        def __init__(self):
            self.value = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("update", "appendList"):
                    self.value = args[0] if name == "update" else [*(self.value or []), *args[0]]
                elif name == "clear":
                    self.value = None
                return self.value is not None if name == "exists" else self.value

            return call

    def run(n):
        found = Assembler((), None)
        found.read, found.open, found.pieces = Value(), Value(), Value()
        calls.clear()
        head = "2026-01-01 00:00:00,000 ERROR [s] app.x: plain "
        given = []
        for begin in (0, n):
            rows = [(k * 2 + j, text, None) for k in range(begin, begin + n) for j, text in enumerate((head + str(k), "more"))]
            rows = rows[1:] if begin else [*rows, (n * 2 - 1 + 0.5, "cut", None)]
            given += [r for out in found.handleInputRows(("f",), iter([pd.DataFrame(rows, columns=["source_offset", "raw", "declared"])]), None) for r in out.itertuples(index=False)]
        assert [r.source_offset for r in given] == [2 * k for k in range(2 * n - 1) if k != n]
        assert given[n - 1].raw == head + str(n - 1) + "\nmore\ncut\nmore"
        return len(calls)

    assert run(3) == run(300)


def test_dated_tables_are_written_in_few_files(spark, tmp_path):
    """A date's rows meet before they are written, and a key's kind is asked for with one test of it."""
    store = EvidenceStore(spark, f"file://{tmp_path}/store")
    day = F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, cast(id % 10 as int))")
    rows = spark.range(4000).repartition(8).select(F.col("id").cast("string").alias("uid"), F.xxhash64("id").alias("content"), "id", F.to_date(day).alias("on_date"))
    store.publish(added={"identities": rows})
    assert store.read("identities").count() == 4000
    assert 10 <= len(list(tmp_path.rglob("*.parquet"))) <= 20
    asked = str(rollups.is_kind(F.col("a"), "k", "array"))
    assert asked.count("try_parse_json") == 1
    texts_ = [('{"k":[1]}', "array"), ('{"k":"x"}', "string"), ('{"k":1.5}', "number"), ('{"k":{}}', "object"), ('{"k":true}', "boolean"), ('{"k":null}', "null"), ("{", None), ("{}", None)]
    for r in spark.createDataFrame(texts_, "a string, kind string").withColumn("found", rollups.json_kind(F.col("a"), "k")).withColumn("holds", rollups.is_kind(F.col("a"), "k", "number")).collect():
        assert r.found == r.kind and r.holds == (r.kind == "number")
