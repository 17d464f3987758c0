"""Document fingerprints: a quartile bucket digest and its bounded difference score.

Every three consecutive bytes are hashed to a bucket and counted. A bucket is written as 0-3,
the quarter of all buckets' counts that its count lies in, two bits each; before them stand a
logarithmic length and the quartiles' ratios. Two digests differ by the steps between their
buckets' codes, and by their heads; both parts are bounded, so the likeness is within 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces
from evidentry.session import materialize

BUCKETS = 256
HEAD_WEIGHT = 0.1
#: Bytes of text in a range of documents, at most about.
RANGE_BYTES = 1 << 28


def _hashed(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    with np.errstate(over="ignore"):
        h = d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA6B) + d[2:] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(24)


def digest(data: bytes) -> str:
    """Hex: one byte of length, one of quartile ratios, two bits a bucket. Fewer than three bytes count no triplet."""
    counts = np.zeros(BUCKETS, np.int64)
    view = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(view) - 2), 1 << 20):
        counts += np.bincount(_hashed(view[at : at + (1 << 20) + 2]), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = min(255, round(math.log2(len(data) + 1) * 8))
    ratios = (int(16 * q1 / q3) if q3 else 0, int(16 * q2 / q3) if q3 else 0)
    head = bytes([length, min(15, ratios[0]) << 4 | min(15, ratios[1])])
    return (head + packed.tobytes()).hex()


def likeness(a: str, b: str) -> float:
    """1 less the bounded difference of two digests; equal digests give 1."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    codes = [np.stack([z[2:] >> 6, z[2:] >> 4 & 3, z[2:] >> 2 & 3, z[2:] & 3]).astype(int) for z in (x, y)]
    steps = np.abs(codes[0] - codes[1])
    body = np.where(steps == 3, 6, steps).sum() / (6 * BUCKETS)
    far = min(1.0, abs(int(x[0]) - int(y[0])) / 32) / 2
    far += (abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))) / 60
    return float(1 - (1 - HEAD_WEIGHT) * min(1.0, 3 * body) - HEAD_WEIGHT * far)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): one row for each row of ``docs``; null texts count as empty, equal texts have equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest((t or "").encode()) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points gives way to as many (or all) first ones of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest beside those of its edited text and of the next document in ascending id order.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next),
    one row for each row of ``docs``. The last document's next is the first; a single one is its
    own. Null texts count as empty; null ids come first; rows with equal ids are ordered by
    their first 16 characters, then by a hash of the text. An empty table gives none.

    Documents are dealt into ranges of ids and sorted there, so that a document's next stands
    beside it. Only the first and last row of each range go on to be matched across ranges.
    """
    spark = docs.sparkSession

    def described(doc: int, text: str, own: str, after: str, theirs: str) -> tuple:
        new = edited(text, after)
        raw = new.encode()
        mark = own if new == text else digest(raw)
        return doc, len(text), hashlib.sha256(raw).hexdigest(), own, mark, likeness(own, mark), likeness(own, theirs)

    names = [f.strip().split(" ")[0] for f in _ROW.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        edges = []

        def packed(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows] + [e[1] if not i else None for e in edges], k) for i, k in enumerate(kinds)]
            columns.append(pa.array([None] * len(rows) + [e[0] for e in edges], pa.int32()))
            columns.append(pa.array([None] * len(rows) + [part] * len(edges), pa.int32()))
            columns.append(pa.array([None] * len(rows) + [e[2] for e in edges], pa.string()))
            return pa.RecordBatch.from_arrays(columns, [*names, "edge", "part", "edge_text"])

        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = digest(text.encode())
                if before is None:
                    edges.append((0, doc, text))
                else:
                    rows.append(described(*before, text, own))
                before = doc, text, own
            yield packed(rows, [])
        if before is not None:
            edges.append((1, before[0], before[1]))
        yield packed([], edges)

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(d, t, digest(t.encode()), n, digest(n.encode())) for d, t, n in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    # The row's number keeps many rows of one doc_id from being one range.
    keys = ["doc_id", "head", "text_hash", "row"]
    numbered = plain.withColumns({"head": F.substring("text", 1, 16), "text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = numbered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = _ROW + ", edge int, part int, edge_text string"
    found = materialize(ordered.mapInArrow(run, schema), "digests")
    # At most two rows a range: the range's last document (edge 1) takes the first (edge 0) of the next range that has rows.
    firsts = found.where("edge = 0").select("part", F.col("edge_text").alias("following"))
    order = sorted(r[0] for r in firsts.select("part").collect())
    after = spark.createDataFrame(list(zip(order, order[1:] + order[:1])), "part int, next_part int")
    lasts = found.where("edge = 1").select("part", "doc_id", F.col("edge_text").alias("text")).join(after, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "following")
    return found.where("edge IS NULL").select(*names).union(pairs.mapInArrow(join_edges, _ROW))
