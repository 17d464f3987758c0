"""Multi-line records: a header line, text, and perhaps a traceback with the exceptions it led to.

Lines are dealt out by ranges of bytes of their files, and each range is scanned in order. What the
scan carries from line to line is small (:class:`OpenRecord`); the raw text goes on in pieces of
bounded size. A record that goes on beyond its range, or beyond a piece, is put together from its
pieces in a second scan, which also tells what stands before a file's first header. So the lines
are read once, a file of any size is many tasks, and no list of a long record's lines is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache
from json.encoder import encode_basestring as quoted
from typing import Any

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentry.session import materialize

PARSED = "struct<reason:string,micros:long,naive:boolean,service:string,level:string,status:int,trace_id:string,message:string,attrs:string>"

#: The lines that records are made of.
HEADER = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\s+([A-Z]+)\s+\[([^\]]+)\]\s+([\w.]+):\s(.*)$"
FRAME = r'^\s+File "([^"]+)", line (\d+)(?:, in (.+))?$'
EXCEPTION = r"^([A-Za-z_][\w.]*)(?:: ?(.*))?$"
START = "Traceback (most recent call last):"
CHAINED = {
    "During handling of the above exception, another exception occurred:",
    "The above exception was the direct cause of the following exception:",
}
_HEADER, _FRAME, _EXCEPTION = re.compile(HEADER), re.compile(FRAME), re.compile(EXCEPTION)
#: Characters of a piece of a record's text; lines are never cut. Bytes of a file that are scanned as one range.
PIECE, RANGE = 1 << 20, 4 << 20
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros_of(value: datetime) -> int:
    since = (value if value.tzinfo else value.replace(tzinfo=UTC)) - _EPOCH
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def record(**values: Any) -> dict[str, Any]:
    base = dict.fromkeys(("reason", "micros", "naive", "service", "level", "status", "trace_id", "message", "attrs"))
    return base | values


FIELDS = list(record())
KINDS = {"micros": pa.int64(), "naive": pa.bool_(), "status": pa.int32()}


def _time_of(text: str) -> datetime:
    """A header's time; its form is known, and ISO's parser is many times faster where digits are ASCII and hours end at 23."""
    if text.isascii() and text[11:13] != "24":
        return datetime.fromisoformat(text)
    return datetime.strptime(text, "%Y-%m-%d %H:%M:%S,%f")


def _frame_of(line: str) -> tuple[str, str] | None:
    """A frame's file and its JSON."""
    if frame := _FRAME.match(line):
        return frame[1], f'{{"file": {quoted(frame[1])}, "line": {int(frame[2])}, "func": {quoted(frame[3] or "<module>")}}}'
    return None


#: Frames are few lines that come again and again.
_known_frame = lru_cache(1 << 14)(_frame_of)


class OpenRecord:
    """What is known of a record so far: its header, whether a traceback is open, the frames, the last exception and its detail."""

    def __init__(self, header: str, roots: tuple[str, ...] = ()):
        self.head, self.roots = _HEADER.match(header), roots
        self.tracing, self.exception, self.detail, self.frames = False, None, [], []

    def take(self, line: str) -> None:
        if self.tracing:
            if frame := (_known_frame if len(line) <= 256 else _frame_of)(line):
                self.frames.append(frame)
            elif not line.startswith((" ", "\t")) and (named := _EXCEPTION.match(line)):
                self.tracing, self.exception, self.detail = False, named[1], [named[2] or ""]
        elif self.exception is None:
            self.tracing = line == START
        elif line in CHAINED:
            self.tracing = True
        else:
            self.detail.append(line)

    def result(self, cut: bool) -> dict[str, Any]:
        """The parsed record; ``cut`` says that another header ended it, so that an open traceback will not go on."""
        if self.head is None:
            return record(reason="unparseable")
        if self.tracing and not cut:
            return record(reason="incomplete_traceback")
        when, level, service, logger, message = self.head.groups()
        try:
            time = _time_of(when)
        except ValueError:
            return record(reason="no_timestamp")
        attrs = [f'{{"logger": {quoted(logger)}']
        if self.tracing:
            attrs.append('"assembly": "incomplete"')
        if self.exception is not None:
            attrs.append(f'"exc_type": {quoted(self.exception)}')
            rest = "\n".join(self.detail).strip()
            message = f"{self.exception}: {rest}" if rest else self.exception
        if self.frames:
            attrs.append(f'"stack": [{", ".join(json for _, json in self.frames)}]')
            own = [json for file, json in self.frames if not self.roots or not file.startswith(self.roots)]
            if own:
                attrs.append(f'"top_frame": {own[-1]}')
        return record(micros=micros_of(time), naive=True, service=service, level=level, message=message, attrs=", ".join(attrs) + "}")


def parse_traceback(lines: list[str], cut: bool, roots: tuple[str, ...] = ()) -> dict[str, Any]:
    """A record whose lines are all there."""
    found = OpenRecord(lines[0], roots)
    for line in lines[1:]:
        found.take(line)
    return found.result(cut)


_SCANNED = f"source_file string, declared string, source_offset long, first long, goes_on boolean, raw string, p {PARSED}, offsets array<long>"
_SCANNED_KINDS = {"source_file": pa.string(), "declared": pa.string(), "source_offset": pa.int64(), "first": pa.int64(), "goes_on": pa.bool_(), "raw": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (source_file, declared, source_offset, first, goes_on, raw, parsed or None, offsets or None)."""
    *plain, parsed, offsets = list(zip(*rows)) or [()] * 8
    columns = [pa.array(c, k) for c, k in zip(plain, _SCANNED_KINDS.values())]
    children = [pa.array([p and p[n] for p in parsed], KINDS.get(n, pa.string())) for n in FIELDS]
    missing = pa.array([p is None for p in parsed], pa.bool_())
    columns += [pa.StructArray.from_arrays(children, FIELDS, mask=missing), pa.array(offsets, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, [*_SCANNED_KINDS, "p", "offsets"])


def _bare(line: str) -> str:
    return line.removesuffix("\r")


def _scan(roots: tuple[str, ...], piece: int):
    """Sorted (source_file, source_offset, raw, declared, is_header, range) -> records that end within their range, and the pieces of others.

    Lines before a range's first header are pieces without source_offset that name their lines' offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        file = spot = declared = start = first = None
        held: list[str | None] = []  # the lines of the piece that is open, and their offsets
        places: list[int] = []
        held_size, whole = 0, True

        def put(cut: bool) -> None:
            """Gives the open piece; it is a record if a header ends it here and no piece of it was given before."""
            nonlocal size, held, places, held_size
            if held:
                ends = cut and whole and start is not None
                parsed = parse_traceback([_bare(x) for x in held], True, roots) if ends else None
                raw = held[0] if len(held) == 1 else "\n".join(held)
                out.append((file, declared, start, first, not ends, raw, parsed, places if start is None else None))
                size += held_size
            held, places, held_size = [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            files, spots = batch.column(0), batch.column(5).to_numpy(zero_copy_only=False)
            headers = pc.fill_null(batch.column(4), False).to_numpy(zero_copy_only=False)
            ats, raws = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            owns = batch.column(3).to_pylist() if batch.column(3).null_count < batch.num_rows else None
            moved = np.ones(len(raws), bool)  # whether a line is of another file or range than the one before
            moved[1:] = (spots[1:] != spots[:-1]) | pc.not_equal(files.slice(1), files.slice(0, len(raws) - 1)).to_numpy(zero_copy_only=False)
            moved[0] = (files[0].as_py(), spots[0]) != (file, spot)
            begins = np.flatnonzero(headers | moved).tolist()
            if not begins or begins[0]:
                begins.insert(0, 0)
            for a, b in zip(begins, [*begins[1:], len(raws)]):
                if headers[a] or moved[a]:
                    put(not moved[a])
                    if moved[a]:
                        file, spot = files[a].as_py(), spots[a]
                    declared, first, whole, start = owns and owns[a], ats[a], True, ats[a] if headers[a] else None
                for raw, at in zip(raws[a:b], ats[a:b]):
                    if held_size >= piece or raw is None or held and held[-1] is None:
                        put(False)
                        first, whole = at, False
                    held.append(raw)
                    held_size += len(raw or "") + 1
                    if start is None:
                        places.append(at)
                    if size >= piece:
                        yield _batch(out)
                        out, size = [], 0
                if len(out) >= 4096:
                    yield _batch(out)
                    out, size = [], 0
        put(False)
        yield _batch(out)

    return run


def _put_together(roots: tuple[str, ...]):
    """Sorted pieces (source_file, declared, source_offset, first, raw, last_header) of records -> the records; one record's text is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = found = None
        texts: list[str] = []
        for batch in batches:
            for f, own, start, _, raw, last in zip(*(c.to_pylist() for c in batch.columns)):
                lines = iter(raw.split("\n"))
                if now is None or now[:3] != (f, own, start):
                    if now is not None:
                        yield _batch([(*now[:3], now[2], False, "\n".join(texts), found.result(now[2] < now[3]), None)])
                    now, found, texts = (f, own, start, last), OpenRecord(_bare(next(lines)), roots), []
                texts.append(raw)
                for line in lines:
                    found.take(_bare(line))
        if now is not None:
            yield _batch([(*now[:3], now[2], False, "\n".join(texts), found.result(now[2] < now[3]), None)])

    return run


def parse_tracebacks(lines: DataFrame, roots: tuple[str, ...] = (), piece: int = PIECE, reach: int = RANGE) -> DataFrame:
    """(source_file, source_offset, raw, declared, p): lines gathered into records at headers.

    Lines before a file's first header are unparseable one by one; a traceback that is open at a
    file's end is incomplete_traceback. A record whose service is another than the declared one
    is ambiguous_service. A task scans ranges of ``reach`` bytes of files.
    """
    bare = F.when(F.endswith("raw", F.lit("\r")), F.regexp_replace("raw", r"\r\z", "")).otherwise(F.col("raw"))
    flagged = lines.select("source_file", "source_offset", "raw", "declared", bare.rlike(HEADER).alias("is_header"), F.floor(F.col("source_offset") / reach).cast("long").alias("range"))
    ordered = flagged.repartition("source_file", "range").sortWithinPartitions("source_file", "source_offset")
    scanned = materialize(ordered.mapInArrow(_scan(roots, piece), _SCANNED), "record-scan")
    whole = scanned.where("NOT goes_on").select("source_file", "source_offset", "raw", "declared", "p")
    bounds = scanned.where("source_offset IS NOT NULL").groupBy(F.col("source_file").alias("of_file")).agg(F.min("source_offset").alias("first_header"), F.max("source_offset").alias("last_header"))
    parts = scanned.where("goes_on").drop("p").join(bounds, F.col("source_file") == F.col("of_file"), "left").drop("of_file")
    inside = F.coalesce(F.col("first") >= F.col("first_header"), F.lit(False))
    none = F.from_json(F.lit('{"reason":"unparseable"}'), PARSED)
    line = F.explode(F.arrays_zip("offsets", F.coalesce(F.split("raw", "\n"), F.array(F.lit(None).cast("string"))).alias("raws")))
    early = parts.where(~inside).select("source_file", "declared", line.alias("line")).select("source_file", F.col("line.offsets").alias("source_offset"), F.col("line.raws").alias("raw"), "declared", none.alias("p"))
    # A piece without a header belongs to the record that was begun last before it; there are a few pieces a range of a file.
    begun = W.partitionBy("source_file").orderBy("first").rowsBetween(W.unboundedPreceding, 0)
    pieces = parts.where(inside).withColumn("source_offset", F.last("source_offset", ignorenulls=True).over(begun))
    keys = ["source_file", "source_offset"]
    together = pieces.repartition(*keys).sortWithinPartitions(*keys, "first").select("source_file", "declared", "source_offset", "first", "raw", "last_header")
    long = together.mapInArrow(_put_together(roots), _SCANNED).select("source_file", "source_offset", "raw", "declared", "p")
    found = whole.unionByName(long).unionByName(early)
    clash = F.col("p.reason").isNull() & (F.col("declared") != F.col("p.service"))
    return found.withColumn("p", F.when(clash, F.col("p").withField("reason", F.lit("ambiguous_service"))).otherwise(F.col("p")))
