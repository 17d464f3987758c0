"""What the operators share: reading the tables and walking Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import contextlib
import ctypes
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key filter at most (64 MB); with more keys than it has room for it lets more rows through, and never a row too few.
MOST_BITS = 1 << 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as a column of ``docs`` has one of them."""
    taken, out = {c.lower() for c in docs.columns}, list(names)
    while any(n.lower() in taken for n in out):
        out = [f"_{n}" for n in out]
    return out


#: What this Python worker keeps between tasks, and when it was last asked for; one thing at a time.
_kept: dict[tuple, tuple[Any, float]] = {}
#: Seconds after which another operator's task lets go of what the worker keeps.
IDLE_S = 15.0


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """A table that is dear to make, such as a tokenizer with its words: kept in the worker until another is asked for, or it idles."""
    value = _kept[key][0] if key in _kept else None
    if value is None:
        _kept.clear()
        value = make()
    _kept[key] = value, time.monotonic()
    return value


def _give_back() -> None:
    """Returns memory that is free in this worker to the machine: a worker outlives its tasks, and the next one may need little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes, one row at least."""
    for key in [k for k, (_, used) in _kept.items() if time.monotonic() - used > IDLE_S]:
        del _kept[key]
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=float))
        part = (np.cumsum(sizes) // limit).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
    _give_back()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes (null: none) end to end, and the offset of each row plus the end."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind, raw = np.int64, column.buffers()
    else:
        kind, raw = np.int32, column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def key_filter(keys: DataFrame, key: Column, of: Column, n: int) -> Column:
    """Whether ``of`` may be among the ``n`` values that ``key`` has in ``keys``: false only where it surely isn't.

    A bitmap of ten bits a key, sent to all tasks as one value. It keeps rows that a join would
    leave alone out of that join's shuffle.
    """
    bits = min(MOST_BITS, 1 << max(10, (10 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    word = lambda c: F.shiftright(place(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    marked = keys.select(word(key).alias("word"), bit(key).alias("bits"))
    every = keys.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marked.groupBy("word").agg(F.bit_or("bits").alias("bits")).union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits"))
    return F.get(table.scalar(), word(of).cast("int")).bitwiseAND(bit(of)) != 0
