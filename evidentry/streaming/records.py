"""Multi-line records from lines that land in pieces: the open record of each file is state.

A header ends the record before it, as in the batch scan. What a micro-batch adds to an open
record is appended to its state, not rewritten. A file's last record ends with a row whose raw
is null, which says that the file has ended, or when no line came for ``idle``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentry.session import SESSION_CONF
from evidentry.sources.records import FIELDS, HEADER, PARSED, OpenRecord, record

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = SESSION_CONF[_PROVIDER]
_OUT = "source_file string, source_offset long, raw string, declared string, parsed string"
_NAMES = ["source_file", "source_offset", "raw", "declared", "parsed"]
_HEADER = re.compile(HEADER)
#: Rows that are given on at once.
OUT_ROWS = 4096


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for streams that start inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Assembler(StatefulProcessor):
    """State of a file: how far it was read, the open record's offset, declared service and text, in pieces."""

    def __init__(self, roots: tuple[str, ...], idle_ms: int | None):
        self.roots, self.idle_ms = roots, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", "up_to long")
        self.open = handle.getValueState("open", "source_offset long, declared string")
        self.pieces = handle.getListState("pieces", "lines string")

    def _parsed(self, file: str, opened: tuple, stored: bool, fresh: list[str], cut: bool) -> tuple[tuple, bool]:
        """The open record as a row, and whether it stays open; its first lines are those of state where ``stored``."""
        start, declared = opened
        lines = [line for row in self.pieces.get() for line in row[0].split("\n")] + fresh if stored else fresh
        found = OpenRecord(lines[0].removesuffix("\r"), self.roots)
        for line in lines[1:]:
            found.take(line.removesuffix("\r"))
        parsed = found.result(cut)
        if parsed["reason"] is None and declared is not None and declared != parsed["service"]:
            parsed["reason"] = "ambiguous_service"
        stays = not cut and parsed["reason"] == "incomplete_traceback"
        return (file, start, "\n".join(lines), declared, json.dumps(parsed, ensure_ascii=False)), stays

    def _clear(self) -> None:
        self.open.clear()
        self.pieces.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is asked once and written once a batch, as each call of it is a message to the JVM; records that begin and end in the batch never reach it."""
        file = key[0]
        up_to = self.read.get()[0] if self.read.exists() else -1
        opened = tuple(self.open.get()) if self.open.exists() else None
        known = stored = opened is not None  # whether state has a record, and whether it is the one that is open
        out: list[tuple] = []
        fresh: list[str] = []  # lines of the open record that state hasn't
        ended = False
        batch = pd.concat(list(rows), ignore_index=True).sort_values("source_offset", kind="stable")
        for at, raw, declared in zip(batch["source_offset"], batch["raw"], batch["declared"]):
            if raw is None or raw != raw:
                ended = True
                continue
            if at <= up_to:
                continue  # read before: a batch is repeated
            up_to, declared = int(at), declared if isinstance(declared, str) else None
            if _HEADER.match(raw.removesuffix("\r")):
                if opened:
                    out.append(self._parsed(file, opened, stored, fresh, True)[0])
                opened, stored, fresh = (up_to, declared), False, [raw]
            elif opened:
                fresh.append(raw)
            else:
                out.append((file, up_to, raw, declared, json.dumps(record(reason="unparseable"))))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=_NAMES)
                out = []
        if ended and opened:
            row, stays = self._parsed(file, opened, stored, fresh, False)
            out.append(row)
            opened = opened if stays else None
        self.read.update((up_to,))
        if known and not (opened and stored):
            self._clear()
        if opened:
            if not stored:
                self.open.update(opened)
            if fresh:
                self.pieces.appendList([("\n".join(fresh),)])
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if opened:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            row, stays = self._parsed(key[0], tuple(self.open.get()), True, [], False)
            out.append(row)
            if not stays:
                self._clear()
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def stream_tracebacks(lines: DataFrame, roots: tuple[str, ...] = (), idle_ms: int | None = None) -> DataFrame:
    """(source_file, source_offset, raw, declared, p) of a stream of lines (source_file, source_offset, raw, declared).

    Equal to the batch scan of all lines once each file has ended. Lines of a file must not
    overtake each other between micro-batches: a line at or before the last one read is taken
    for a repeat. A traceback that is open when its file ends, or idles, is reported as
    incomplete_traceback and stays open, so that the lines it still gets complete it; lines
    after any other ended record are unparseable until the next header. The session needs the
    state store of :data:`STATE_STORE`, as :func:`build_session` and :func:`state_store` set it.
    """
    plain = lines.select("source_file", F.col("source_offset").cast("long").alias("source_offset"), "raw", "declared")
    mode = "None" if idle_ms is None else "ProcessingTime"
    found = plain.groupBy("source_file").transformWithStateInPandas(Assembler(roots, idle_ms), _OUT, "Append", mode)
    assert len(FIELDS) == PARSED.count(":")
    return found.select("source_file", "source_offset", "raw", "declared", F.from_json("parsed", PARSED).alias("p"))
