"""JSON lines in built-in functions against Python's parser."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidentry.functions.jsonvalues import iso_time, with_object
from evidentry.sources import formats
from tests.plain import iso, json_line

TS = '"ts":"2026-08-19T14:03:22.5Z"'
LINES = [
    f'{{{TS},"msg":"plain"}}', f'{{{TS},"msg":"a","msg":"b","level":"x","level":"WARN"}}', f'{{{TS},"msg":"a"}} x', f'{{{TS},"msg":"a"}}{{}}', f'{{{TS},"msg":"a"}}],[1', f'{{{TS},"msg":"a"}}],[{{"b":2}}', f'{{{TS},"msg":"a"}},"y":{{}}',
    f'{{{TS},"msg":"a","list":[{{"k":1}}, {{"k":[]}}]}}', f'[{{{TS},"msg":"a"}}]', "[]", "7", '"x"', "null", "", " ", "{", "{}", f'{{{TS}}}', f'{{{TS},"msg":null}}', f'{{{TS},"msg":5}}', '{"msg":"a"}', '{"msg":"a","ts":5}', '{"msg":"a","ts":"soon"}',
    f'  {{{TS},"msg":"a"}}\t', f'{{{TS},"msg":"a","status":"504"}}', f'{{{TS},"msg":"a","status":504}}', f'{{{TS},"msg":"a","status":true}}', f'{{{TS},"msg":"a","status":null}}', f'{{{TS},"msg":"a","status":5.5}}', f'{{{TS},"msg":"a","status":"５"}}', f'{{{TS},"msg":"a","status":99999999999}}',
    f'{{{TS},"msg":"a","status":"99999999999999999999"}}', f'{{{TS},"msg":"a","status":[1]}}', f'{{{TS},"msg":"a","duration_ms":"7"}}', f'{{{TS},"msg":"a","duration_ms":null}}', f'{{{TS},"msg":"a","duration_ms":7}}', f'{{{TS},"msg":"a","duration_ms":7.25}}', f'{{{TS},"msg":"a","duration_ms":true,"status":{{}}}}',
    f'{{{TS},"msg":"a","duration_ms":"x","coercion_dropped":5}}', f'{{{TS},"msg":"a","coercion_dropped":5}}', f'{{{TS},"msg":"a","service":5,"trace_id":[],"level":{{}}}}', f'{{{TS},"msg":"a","service":"s","trace_id":"t","level":"info"}}', f'{{{TS},"msg":"a","":1,"a.b":{{"c":null,"c":2}},"é\\u00e9":"\\n\\"\\\\"}}',
    f'{{{TS},"msg":"a","n":NaN}}', f'{{{TS},"msg":"a","n":-1.5e3}}', f'{{{TS},"msg":"a","n":01}}', f"{{{TS},'msg':'a'}}", f'{{{TS},"msg":"a",}}', f'{{{TS},"msg":"tab\there"}}', f'{{{TS},"msg":"a","big":123456789012345678901}}', '{"ts":"2026-03-08T02:30:00","msg":"naive"}',
    f'{{{TS},"msg":"{"long " * 30_000}"}}',
]


def parsed(spark, lines):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    return {r.i: r.p.asDict() for r in formats.parse_json_lines(rows.withColumn("declared", F.lit("d"))).select("i", "p").collect()}


def same(found, expected):
    if expected["reason"]:
        return found["reason"] == expected["reason"] and all(v is None for k, v in found.items() if k != "reason")
    return {k: json.loads(v) if k == "attrs" and v else v for k, v in found.items()} == expected


def test_lines_against_the_plain_parser(spark):
    found = parsed(spark, LINES + [x + "\r" for x in LINES])
    for i, line in enumerate(LINES + LINES):
        assert same(found[i], json_line(line)), (line[:200], found[i], json_line(line))


def test_cut_and_spliced_lines(spark):
    rng = random.Random(6)
    lines = []
    for _ in range(4000):
        a, b = rng.choice(LINES[:-1]), rng.choice(LINES[:-1])
        lines.append(a[: rng.randrange(len(a) + 1)] + rng.choice(["", "]", "}", ",", " ", "],[", "},{"]) + b[rng.randrange(len(b) + 1) :])
    found = parsed(spark, lines)
    for i, line in enumerate(lines):
        assert same(found[i], json_line(line)), (line, found[i], json_line(line))


def test_times_against_python(spark):
    rng = random.Random(2)
    parts = ["2026", "-08", "-19", "08", "19", "T", " ", "14", ":03", "03", ":22", "22", ".5", ",123456789", ".000001", "Z", "+02:00", "-0530", "+14", "-00:00:30", "+01:02:03.5", "24", ":60", "-13", "é", "\n", "0000"]
    shapes = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    shapes += [f"{d}{t}{z}" for d in ("2026-02-29", "2024-02-29", "20260819", "2026-08", "0001-01-01", "9999-12-31") for t in ("", "T00", " 23:59", "T235959", "x23:59:59.9999999", "T24:00", "T1:00", "T10:0") for z in ("", "Z", "z", "+23:59", "-24:00", "+2", "+02:60")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(shapes)], "i int, t string")
    micros, naive = iso_time(F.col("t"))
    for r in rows.select("i", micros.alias("m"), naive.alias("n")).collect():
        text = shapes[r.i]
        try:
            time = iso(text)
        except ValueError:
            time = None
        if "W" in text or time is not None and time.tzinfo and not 2 < time.year < 9998:
            continue
        expected = None if time is None else (time.replace(tzinfo=None) - (time.utcoffset() or timedelta(0)) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        assert r.m == expected, (text, r.m, expected, time)
        assert expected is None or r.n == (time.tzinfo is None), text


def test_the_session_keeps_its_rule_for_equal_keys(spark):
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    rows = with_object(spark.createDataFrame([('{"a":{"b":1,"b":2},"a":{"b":3,"b":4}}',)], "t string"), F.col("t"), "o")
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == before
    assert rows.select(F.to_json("o").alias("j")).first().j == '{"a":{"b":4}}'
