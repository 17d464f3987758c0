"""Token files: ids under a static range asymmetric numeral system, in independent blocks.

A folder holds two Parquet tables, so that any store Spark writes to will do and lost
executors' work is committed once: ``table`` has the shared symbol frequencies (scaled to
``2 ** SCALE_BITS``, bounded by the vocabulary), ``blocks`` the blocks, one row for each segment
between two checkpoints. A block holds whole documents in ascending doc_id order, ``block_tokens``
ids or a single longer document. Its frame, and that of a segment alone, is:

    magic 4 bytes | version u16 | lanes u16 | n_tokens u64 | n_words u64
    steps between checkpoints u32 | crc32 of all that follows u32
    checkpoints: for each, first word u64 | crc32 of the segment's ids (as u32) u64 | one u64 state a lane
    words: u32 each

Ids go round-robin to the lanes; the lanes share one stream of words, which each step reads
in lane order. A checkpoint has all that a decoder needs to start there, so the segments
between checkpoints are decoded in any order, by any task, each against its own checksum.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces, utf8
from evidentry.llm.tokenize import default_path, tokenizer
from evidentry.session import discard, materialize

SCALE_BITS, LOW = 18, 1 << 31
HEAD = struct.Struct("<4sHHQQII")
MAGIC, VERSION = b"EVTK", 2


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Integer frequencies that sum to ``2 ** bits``; every symbol that occurs keeps one at least, so there may be ``2 ** bits`` of them."""
    total, room = int(counts.sum()), 1 << bits
    if np.count_nonzero(counts) > room:
        raise ValueError(f"{np.count_nonzero(counts)} symbols occur, and a table of {room} has no place for each")
    if not total:
        return np.zeros_like(counts)
    out = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-out, kind="stable")
    order = order[out[order] > 0]
    gap, k = room - int(out.sum()), 0
    while gap:
        i = order[k % len(order)]
        if gap > 0:
            step = gap if not k else 1
        else:
            step = -min(-gap, int(out[i]) - 1, max(1, int(out[i]) // 8))
        out[i] += step
        gap -= step
        k += 1
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, frequencies: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = frequencies.astype(np.uint64)
        self.start = np.r_[0, np.cumsum(frequencies)[:-1]].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray, lanes: int, every: int = 1 << 10) -> bytes:
        """The frame of a block, with a checkpoint each ``every`` steps of ``lanes`` ids."""
        n, bits = len(ids), np.uint64(self.bits)
        lanes = max(1, min(lanes, n))
        states, words, written, points = np.full(lanes, LOW, np.uint64), [], 0, []
        for s in range(math.ceil(n / lanes) - 1, -1, -1):
            lo, hi = s * lanes, min(n, (s + 1) * lanes)
            own = ids[lo:hi]
            x, f = states[: hi - lo], self.freq[own]
            full = x >= f << np.uint64(63 - self.bits)
            k = int(np.count_nonzero(full))
            if k:
                words.append(x[full].astype("<u4"))  # the low half
                written += k
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            states[: hi - lo] = (q << bits) + (x - q * f) + self.start[own]
            if s % every == 0:
                crc = zlib.crc32(ids[lo : lo + every * lanes].astype("<u4"))
                points.append((written, crc, states.astype("<u8").tobytes()))
        marks = b"".join(struct.pack("<QQ", written - w, crc) + x for w, crc, x in reversed(points))
        data = marks + b"".join(w.tobytes() for w in reversed(words))
        return HEAD.pack(MAGIC, VERSION, lanes, n, written, every, zlib.crc32(data)) + data

    def cut(self, frame: bytes) -> Iterator[bytes]:
        """A frame for each segment of a block's frame, with its checkpoint and its words alone."""
        _, _, lanes, n, n_words, every, _ = HEAD.unpack_from(frame)
        size, count = 16 + 8 * lanes, math.ceil(n / (lanes * every))
        begins = [struct.unpack_from("<Q", frame, HEAD.size + k * size)[0] for k in range(count)] + [n_words]
        for k in range(count):
            at = HEAD.size + k * size
            data = bytes(8) + frame[at + 8 : at + size] + frame[HEAD.size + count * size + 4 * begins[k] : HEAD.size + count * size + 4 * begins[k + 1]]
            yield HEAD.pack(MAGIC, VERSION, lanes, min(n - k * lanes * every, lanes * every), begins[k + 1] - begins[k], every, zlib.crc32(data)) + data

    def segments(self, frame: bytes, which: list[int] | None = None) -> Iterator[np.ndarray]:
        """The ids of each segment, or of those in ``which``, each decoded from its own checkpoint."""
        magic, version, lanes, n, n_words, every, crc = HEAD.unpack_from(frame)
        if (magic, version) != (MAGIC, VERSION) or zlib.crc32(memoryview(frame)[HEAD.size :]) != crc:
            raise ValueError("a token block's head or checksum is wrong")
        count = math.ceil(n / (lanes * every))
        point = np.dtype([("word", "<u8"), ("crc", "<u8"), ("states", "<u8", (lanes,))])
        points = np.frombuffer(frame, point, count, HEAD.size)
        words = np.frombuffer(frame, "<u4", n_words, HEAD.size + count * point.itemsize)
        for k in range(count) if which is None else which:
            end = int(points["word"][k + 1]) if k + 1 < count else n_words
            own = words[int(points["word"][k]) : end].astype(np.uint64)
            yield self._decode(points["states"][k].copy(), own, min(n - k * lanes * every, lanes * every), int(points["crc"][k]))

    def _decode(self, states: np.ndarray, words: np.ndarray, n: int, crc: int) -> np.ndarray:
        out, at, lanes = np.empty(n, "<u4"), 0, len(states)
        mask, bits, low = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.uint64(LOW)
        for lo in range(0, n, lanes):
            x = states[: min(lanes, n - lo)]
            slot = x & mask
            ids = self.symbol[slot]
            out[lo : lo + len(x)] = ids
            x = self.freq[ids] * (x >> bits) + slot - self.start[ids]
            short = np.flatnonzero(x < low)
            if len(short):
                x[short] = (x[short] << np.uint64(32)) | words[at : at + len(short)]
                at += len(short)
            states[: len(x)] = x
        if at != len(words) or zlib.crc32(out) != crc:
            raise ValueError("a token block's ids don't match their checksum")
        return out

    def decode(self, frame: bytes) -> np.ndarray:
        """All ids of a block."""
        return np.concatenate([np.zeros(0, "<u4"), *self.segments(frame)])


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, counts): each document's ids with the end id, two bytes each where the vocabulary allows, else four.

    The last row of each task has ``counts`` instead: how often it met each id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, end_id)
        width = np.dtype(coder.wide).itemsize
        total, names = np.zeros(coder.vocabulary, np.int64), ["doc_id", "n_tokens", "ids", "counts"]
        for batch in pieces(batches):
            ids = coder.encoded(batch.column(1))
            total += np.bincount(utf8(ids)[0].view(coder.wide), minlength=coder.vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.divide(pc.binary_length(ids), width), pa.int64()), ids, pa.nulls(len(ids), pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def symbol_counts(ids: DataFrame) -> DataFrame:
    """(symbol, n) over all ids; each task sends its own sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = total + np.frombuffer(raw, np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["symbol", "n"])

    return ids.where("counts IS NOT NULL").select("counts").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


BLOCKS = "shard int, block long, segment int, first_token long, n_tokens long, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>, frame binary"
BLOCK_NAMES = [c.split(" ")[0] for c in BLOCKS.split(", ")]
_BLOCK_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials of crc32 (the highest bit is the constant term), reduced."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc32(first: int, second: int, length: int) -> int:
    """The crc32 of two strings end to end, from theirs and the second one's length in bytes."""
    power, shift = 1 << 23, 1 << 31  # x^8, for one byte, and 1
    while length:
        if length & 1:
            shift = _times(shift, power)
        power, length = _times(power, power), length >> 1
    return _times(first, shift) ^ second


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    lanes: int = 2048,
    block_tokens: int = 1 << 21,
    steps: int = 128,
    shard_tokens: int = 1 << 26,
) -> None:
    """Encodes every whole text and writes the folder described above, with a checkpoint each ``steps`` ids of each lane.

    Shards are ranges of doc_id, numbered in its order, ``shards`` of them or as many as shuffle
    partitions, and more where a shard would have over ``shard_tokens`` ids. first_token and
    doc_starts count from the shard's start; :func:`read_token_files` adds the shards' totals. Null doc_ids come first; rows
    with the same doc_id lie next to each other. Null and empty texts are the end id alone.
    An empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path("byte_bpe_50k.json")
    ids = materialize(encoded(docs, path, end_id, id_col, text_col), "token-ids")
    found = sorted(map(tuple, symbol_counts(ids).collect()))  # at most the vocabulary
    counts = np.zeros(found[-1][0] + 1 if found else 0, np.int64)
    counts[[symbol for symbol, _ in found]] = [n for _, n in found]
    frequencies = scaled(counts)
    rows = [(symbol, n, int(frequencies[symbol])) for symbol, n in found]
    spark.createDataFrame(rows, "symbol int, n long, frequency int").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(frequencies)

    lanes_of = lambda n: max(1, min(lanes, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard, first, number = Coder(shared.value), TaskContext.get().partitionId(), 0, 0
        names: list = []
        sizes: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal first, number
            raw, n = b"".join(held), sum(sizes)
            frame = coder.encode(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"), lanes, steps)
            ends = np.cumsum(sizes)
            starts, rows, at = ends - sizes, [], 0
            for k, piece in enumerate(coder.cut(frame)):
                size = min(n - at, lanes_of(n) * steps)
                low, high = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + size, "left")  # documents that have ids here
                rows.append((shard, number, k, first + at, size, names[low:high], (first + starts[low:high]).tolist(), sizes[low:high], piece))
                at += size
            first, number = first + n, number + 1
            names.clear(), sizes.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), _BLOCK_KINDS)], BLOCK_NAMES)

        n = 0
        for batch in batches:
            for doc, size, part in zip(*(c.to_pylist() for c in batch.columns)):
                if sizes and n + size > block_tokens:
                    yield close()
                    n = 0
                names.append(doc), sizes.append(size), held.append(part)
                n += size
        if sizes:
            yield close()

    n_shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(counts.sum() / shard_tokens))
    # The row's number keeps many rows of one doc_id from being one range.
    keys = ["doc_id", "n_tokens", "hash", "row"]
    numbered = ids.where("n_tokens IS NOT NULL").select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = numbered.repartitionByRange(n_shards, *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    discard(ids)


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): one row for each document written, decoded from the blocks.

    start is the number of ids of all documents before it; ids are little-endian unsigned 32-bit.
    Segments are decoded each by itself; the checksums of a document in several are put together.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    table = spark.read.parquet(f"{folder}/table").select("symbol", "frequency").collect()
    frequencies = np.zeros(1 + max((r[0] for r in table), default=0), np.int64)
    for symbol, f in table:
        frequencies[symbol] = f
    shared = spark.sparkContext.broadcast(frequencies)
    schema = "doc_id long, shard int, in_shard long, n_tokens long, at long, part long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for shard, first, docs, starts, sizes, frame in zip(*(c.to_pylist() for c in batch.columns)):
                ids = coder.decode(frame)
                lows = [max(0, s - first) for s in starts]
                parts = [ids[low : s + n - first] for low, s, n in zip(lows, starts, sizes)]
                crcs = [zlib.crc32(p) for p in parts]
                columns = [docs, [shard] * len(docs), starts, sizes, [first + low - s for low, s in zip(lows, starts)], [len(p) for p in parts], crcs]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                columns = [pa.array(v, k) for v, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([p.tobytes() for p in parts], pa.binary())] * keep_ids, [c.split(" ")[0] for c in schema.split(", ")])

    def whole(group: pa.Table) -> pa.Table:
        """The parts of one document that lies in several segments, end to end."""
        group = group.sort_by("at")
        crc = 0
        for part, own in zip(group["part"].to_pylist(), group["ids_crc32"].to_pylist()):
            crc = joined_crc32(crc, own, 4 * part)
        out = group.slice(0, 1).drop_columns(["at", "part", "ids_crc32"] + ["ids"] * keep_ids).append_column("ids_crc32", pa.array([crc], pa.int64()))
        return out.append_column("ids", pa.array([b"".join(group["ids"].to_pylist())], pa.binary())) if keep_ids else out

    names = ["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
    parts = blocks.select("shard", "first_token", "doc_ids", "doc_starts", "doc_tokens", "frame").mapInArrow(run, schema)
    parts = materialize(parts, "token-parts")
    split = parts.where("part < n_tokens").groupBy("shard", "in_shard").applyInArrow(whole, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    read = parts.where("part = n_tokens").select(*names).unionByName(split)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()  # one row a shard
    before, total = [], 0
    for shard, n in sorted(totals):
        before.append((shard, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "shard int, before long"))  # as many rows as shards
    out = read.join(starts, "shard").withColumn("start", F.col("before") + F.col("in_shard"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)
