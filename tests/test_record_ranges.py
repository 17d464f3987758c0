"""Records by ranges of bytes of their files: the same result, from one reading of the lines."""

from __future__ import annotations

from evidentry.sources import records
from tests.test_records import LINES, made, plain, told


def test_lines_are_read_once(spark):
    """Headers' bounds, early lines and ranges come from the one scan, however many ranges a file has."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = made(5)
    lines = spark.createDataFrame(rows, LINES).mapInArrow(counted, LINES)
    assert told(records.parse_tracebacks(lines)) == plain(rows) and read.value == len(rows)
    for piece in (60, 1 << 20):
        assert told(records.parse_tracebacks(spark.createDataFrame(rows, LINES), ("/lib",), piece, reach=150)) == plain(rows, ("/lib",))


def test_times_of_headers():
    """ISO's parser takes and refuses what the form's own does."""
    head = "{} ERROR [svc] app.x: it failed"
    for when, good in (("2026-08-19 23:59:59,999", True), ("2026-08-19 24:00:00,000", False), ("2026-02-30 00:00:00,000", False), ("0000-01-01 00:00:00,000", False), ("2026-01-01 00:00:60,000", False), ("٢026-08-19 10:00:00,000", True), ("9999-12-31 23:59:59,999", True)):
        found = records.parse_traceback([head.format(when)], True)
        assert (found["reason"] is None) == good, when
    assert found["micros"] == 253402300799999000
