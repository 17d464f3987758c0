"""Multi-line records: by ordered scans over ranges, and from a stream, against whole lists of lines."""

from __future__ import annotations

import random
import re
import resource
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidentry.functions.identity import python_uid
from evidentry.sources import formats, lines, rawlines, records
from evidentry.streaming.records import stream_tracebacks
from tests.plain import parse_traceback

LINES = "source_file string, source_offset long, raw string, declared string"
HEAD = "2026-08-19 14:03:22,123 ERROR [svc] app.x: it failed"
POOL = [
    HEAD, HEAD, "2026-08-19 14:03:23,001 INFO [other] app.y: fine", "2026-08-19 25:03:23,001 INFO [svc] app.y: no such hour", records.START, records.START, '  File "/srv/app.py", line 4, in run', '\tFile "/lib/dep.py", line 9', "ValueError: bad",
    "KeyError", "  indented: text", "more detail", "", " ", "\r", "During handling of the above exception, another exception occurred:", "The above exception was the direct cause of the following exception:", "1.2: no name", HEAD + "\r", records.START + "\r", "a.b.Error: x\r",
]


def made(seed, files=5, n=160):
    rng = random.Random(seed)
    out = []
    for f in range(files):
        at = 0
        for raw in rng.choices(POOL, k=rng.randrange(n)):
            out.append((f"logs/{f}.log", at, raw, "svc" if f == 1 else None))
            at += len(raw.encode()) + 1
    out += [("logs/none.log", 0, "no header here", None), ("logs/none.log", 15, records.START, None), ("logs/one.log", 0, HEAD, "svc")]
    return out


def plain(rows, roots=()):
    """(file, offset) -> (raw, parsed) from each file's list of lines."""
    out = {}
    for file in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == file)
        starts = [i for i, r in enumerate(own) if re.match(records.HEADER, r[2].removesuffix("\r"))]
        for r in own[: starts[0] if starts else len(own)]:
            out[file, r[1]] = r[2], records.record(reason="unparseable")
        for a, b in zip(starts, [*starts[1:], len(own)]):
            raws = [r[2] for r in own[a:b]]
            parsed = parse_traceback([x.removesuffix("\r") for x in raws], a != starts[-1], roots)
            if parsed["reason"] is None and own[a][3] is not None and own[a][3] != parsed["service"]:
                parsed["reason"] = "ambiguous_service"
            out[file, own[a][1]] = "\n".join(raws), parsed
    return out


def told(df):
    rows = [(r.source_file, r.source_offset, r.raw, r.p.asDict()) for r in df.collect()]
    found = {r[:2]: r[2:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("piece", [1, 60, 1 << 20])
def test_scan_against_lists(spark, piece):
    for seed in (1, 2):
        rows = made(seed)
        for roots in ((), ("/lib",)):
            assert told(records.parse_tracebacks(spark.createDataFrame(rows, LINES).repartition(3), roots, piece)) == plain(rows, roots)


def test_scan_with_many_ranges(spark):
    rows = made(3, files=2, n=400)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(records.parse_tracebacks(spark.createDataFrame(rows, LINES), (), 30)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_no_lines(spark):
    assert records.parse_tracebacks(spark.createDataFrame([], LINES)).count() == 0


def test_one_header_with_a_million_lines(spark):
    """The record's text is the only thing that grows with it: the scan holds a piece of it, whatever its length."""
    n = 1_000_000
    body = F.when(F.col("id") == 0, HEAD).when(F.col("id") == 1, records.START).when(F.col("id") == n - 2, "ValueError: bad").when(F.col("id") == n - 1, "the end").otherwise(F.concat(F.lit("  text "), (F.col("id") % 7).cast("string")))
    rows = spark.range(n).select(F.lit("logs/big.log").alias("source_file"), (F.col("id") * 16).alias("source_offset"), body.alias("raw"), F.lit(None).cast("string").alias("declared"))
    found = records.parse_tracebacks(rows)
    r = found.select("source_offset", F.length("raw").alias("n"), F.size(F.split("raw", "\n")).alias("lines"), "p.message", "p.reason").collect()
    assert len(r) == 1 and (r[0].source_offset, r[0].lines, r[0].message, r[0].reason) == (0, n, "ValueError: bad\nthe end", None)
    batches = ((list(range(a, a + 10_000)), a) for a in range(0, n, 10_000))

    def arrow():
        import pyarrow as pa

        for ids, a in batches:
            raws = [HEAD if i == 0 else "  text" for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(ids)), pa.array(ids), pa.array(raws), pa.nulls(len(ids), pa.string()), pa.array([i == 0 for i in ids]), pa.array([0] * len(ids))], list("abcdef"))

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    pieces = sum(b.num_rows for b in records._scan((), 1 << 16)(arrow()))
    assert pieces > 50 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def streamed(spark, tmp_path, batches, trigger=None, **how):
    """The output after each batch of rows has landed and been taken."""
    source, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    source.mkdir()
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(source))
        found = stream_tracebacks(spark.readStream.schema(LINES).parquet(str(source)), **how)
        found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).trigger(**(trigger or {"availableNow": True})).start().awaitTermination(60)
    return spark.read.parquet(str(out))


def test_lines_that_land_in_pieces_give_the_batch_run(spark, tmp_path):
    rows = made(4, files=3, n=60)
    files = sorted({r[0] for r in rows})
    rng = random.Random(1)
    cuts = {f: sorted(rng.randrange(0, 4000) for _ in range(3)) for f in files}
    piece_of = lambda r: sum(r[1] >= c for c in cuts[r[0]])
    batches = [[r for r in rows if piece_of(r) == k] for k in range(4)]
    rng.shuffle(batches[1])
    batches[2] += batches[1][:5]  # lines that come again
    batches.append([(f, 1 << 40, None, None) for f in files])
    found = streamed(spark, tmp_path, batches)
    assert told(found) == plain(rows) == told(records.parse_tracebacks(spark.createDataFrame(rows, LINES)))


def test_an_open_traceback_is_reported_and_can_still_end(spark, tmp_path):
    first = [("f", 0, HEAD, None), ("f", 60, records.START, None), ("f", 100, '  File "a.py", line 1', None)]
    later = [("f", 140, "ValueError: late", None), ("f", 160, HEAD, None), ("f", 1 << 40, None, None)]
    found = streamed(spark, tmp_path, [first, [("f", 1 << 40, None, None)], later])
    rows = sorted((r.source_offset, len(r.raw), r.p.reason, r.p.message) for r in found.collect())
    assert [(r[0], r[2], r[3]) for r in rows] == [(0, "incomplete_traceback", None), (0, None, "ValueError: late"), (160, None, "it failed")]


def test_an_idle_record_ends(spark, tmp_path):
    found = streamed(spark, tmp_path, [[("f", 0, HEAD, None), ("f", 60, "text", None)], [("g", 0, HEAD, None)], [("f", 70, "after the end", None)]], idle_ms=1, trigger={"once": True})
    rows = {(r.source_file, r.source_offset): (r.raw, r.p.reason) for r in found.collect()}
    assert rows["f", 0] == (HEAD + "\ntext", None) and rows["f", 70] == ("after the end", "unparseable")


BODY = b'{"ts":"2026-08-19T14:03:22Z","service":"svc","msg":"bad \xff\xfe byte \xe2\x82"}\n' + b'{"ts":"2026-08-19T14:03:22Z","service":"svc","msg":"caf\xc3\xa9"}\r\n' + "é́ x\n".encode() + b'{"ts":"2026-08-19T14:03:23Z","service":"svc","msg":"last"}'


def test_ill_formed_bytes_keep_their_identity(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(BODY)
    services = spark.createDataFrame([(1, "svc", "UTC")], "id int, name string, log_timezone string")
    named = lambda df: df.withColumn("source_file", F.lit("logs/a.log"))
    by_bytes = rawlines.read_lines(spark, str(tmp_path), split_bytes=11)
    by_text = lines.scan_lines(spark, str(tmp_path))
    expected = []
    at = 0
    for raw in BODY.split(b"\n"):
        text = raw.removesuffix(b"\r").decode("utf-8", "replace")
        expected.append((at, python_uid("log", file="logs/a.log", offset=at, raw=unicodedata.normalize("NFC", text))))
        at += len(raw) + 1
    for found in (by_bytes, by_text):
        drafts = formats.drafts(named(found), services).collect()
        assert sorted((r.source_offset, r.uid) for r in drafts) == expected
        assert [r.message for r in sorted(drafts, key=lambda r: r.source_offset)] == ["bad �� byte �", "café", None, "last"]


def test_a_raw_aware_format_gets_the_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(BODY)
    seen = formats.LogFormat("bytes", lambda raw: F.lit(True), lambda rows: rows.withColumn("p", F.from_json(F.concat(F.lit('{"reason":"'), F.hex(F.substring("raw_bytes", -1, 1)), F.lit('"}')), records.PARSED)), raw_aware=True)
    services = spark.createDataFrame([(1, "svc", "UTC")], "id int, name string, log_timezone string")
    found = formats.drafts(rawlines.read_lines(spark, str(tmp_path)), services, formats=(seen,))
    assert [r.reason for r in found.orderBy("source_offset").collect()] == ["7D", "0D", "78", "7D"]


def test_splits_of_files_against_lists(tmp_path):
    rng = random.Random(2)
    for t in range(60):
        body = b"".join(rng.choice([b"a", b"\n", b"\n", b"\xff", b"bcd", b"\r", b"x" * 9]) for _ in range(rng.randint(0, 60)))
        path = str(tmp_path / f"f{t}")
        with open(path, "wb") as f:
            f.write(body)
        expected, at = [], 0
        for line in body.split(b"\n"):
            expected.append((at, line))
            at += len(line) + 1
        if expected[-1][1] == b"":
            expected.pop()
        for size in (1, 3, 7, 1000):
            for chunk in (1, 2, 5, 4096):
                got = [row for s in rawlines._splits(path, 0, len(body), size) for b in rawlines.lines_of(s, chunk) for row in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                assert got == expected, (body, size, chunk)
        assert rawlines._finished(path, len(body), 0) == body.rfind(b"\n") + 1


def test_growing_files_as_a_stream(spark, tmp_path):
    source, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    source.mkdir()
    told_ = []
    for name, data in (("a", b"one\ntw"), ("a", b"o\n"), ("b", b"x\n\n"), ("a", b"three"), ("a", b"\n\xff\n"), ("_skipped", b"y\n")):
        with open(source / name, "ab") as f:
            f.write(data)
        query = rawlines.stream_lines(spark, str(source), split_bytes=4).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(marks)).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        rows = spark.read.parquet(str(out)).collect()
        told_.append(len(rows))
    assert told_ == [1, 2, 4, 4, 6, 6]
    found = sorted((r.source_file.rsplit("/", 1)[1], r.source_offset, bytes(r.raw)) for r in rows)
    assert found == [("a", 0, b"one"), ("a", 4, b"two"), ("a", 8, b"three"), ("a", 14, b"\xff"), ("b", 0, b"x"), ("b", 2, b"")]
