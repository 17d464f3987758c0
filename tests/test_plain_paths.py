"""The short ways that most log lines take give what the long ways give, in less time."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from evidentry.functions import identity, jsonvalues, texts


def test_messages_of_words_and_numbers(spark):
    """Templates by one expression are those of the whole pass, at a fraction of its time."""
    dice = random.Random(5)
    pool = ["bad", "Value", ":", " ", " ", "\n", "  ", "7", "12345678", "deadbeef", "feedfacecafe", "k", "g9", "a1", "0x12", "-", ".", "3.5", "ms", "m", ",", "!", "x@b.c", "/a/b", "é", "<NUM>", "_", "'", "1:2", "\t"]
    rows = [("".join(dice.choice(pool) for _ in range(dice.randint(0, 9))),) for _ in range(20000)] + [(None,), ("KeyError: key 123\nstray 456",), ("purchase by user 9",)]
    frame = spark.createDataFrame(rows, "m string").cache()
    wrong = frame.where(~texts.mask("m").eqNullSafe(texts._of_any(F.col("m")))).collect()
    assert not wrong and frame.where(F.col("m").rlike(texts._SIMPLE)).count() > 500
    plain = spark.range(100_000).select(F.concat(F.lit("KeyError: key "), F.col("id").cast("string"), F.lit("\nstray line of text "), F.col("id").cast("string")).alias("m")).coalesce(1).cache()

    def seconds(column):
        plain.select(F.sum(F.length(column))).collect()
        began = time.time()
        plain.select(F.sum(F.length(column))).collect()
        return time.time() - began

    assert seconds(texts.mask("m")) < seconds(texts._of_any(F.col("m"))) / 2


def test_usual_times(spark):
    rows = [(x,) for x in ("2026-08-19T14:03:22.123456Z", "2026-08-19T14:03:22", "2026-08-19T14:03:22.1Z", "2026-02-30T00:00:00Z", "2026-01-01T24:00:00Z", "0000-01-01T00:00:00Z", "0001-01-01T00:00:00Z", "2026-01-01T00:00:60Z", "9999-12-31T23:59:59.999999Z", "1960-01-01T00:00:00.5Z", "2026-08-19T14:03:22.1234567Z", "2026-08-19T14:03:22+01:00", "x", None)]
    frame = spark.createDataFrame(rows, "t string")
    short, long = jsonvalues.iso_time(F.col("t")), jsonvalues._any_iso_time(F.col("t"))
    for row in frame.select("t", short[0].alias("a"), long[0].alias("b"), short[1].alias("c"), long[1].alias("d")).collect():
        assert row.a == row.b and (row.a is None or row.c == row.d), row


def test_strings_with_any_control_character(spark):
    import json

    rows = ["plain", "", 'a"b\\c\n', "tab\tline\r\n", "\x00\x01\x1f\n", "\x0b\x0c\x08", "é\x07"]
    frame = spark.createDataFrame([(x,) for x in rows], "t string")
    assert [r[0] for r in frame.select(identity.json_string(F.col("t"))).collect()] == [json.dumps(x, ensure_ascii=False) for x in rows]
