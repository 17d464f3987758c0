"""Best-fit packing of tokenised documents under several capacities at once.

Documents longer than the token capacity are cut; nothing else is. The pieces are dealt by a
hash to groups of about ``group_size`` pieces, a number that follows the data, and each
group is packed by itself in decreasing order, so no task ever holds more than a group.
A piece goes to the open sequence that fits it under every capacity (tokens, documents,
attention cost) and leaves the smallest weighted norm of what remains ("norm"), or has the
largest weighted dot-product of demand and use ("dot").
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces as bounded
from evidentry.llm.tokenize import default_path, tokenizer
from evidentry.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool, cached_words: int) -> DataFrame:
    """One row a piece: where it starts in its document's ids, its length and checksum, the ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path, end_id, cached_words), np.array([end_id], "<u4").tobytes()
        for batch in bounded(batches, limit=1 << 20):
            doc, no, start, size, crc, kept = [], [], [], [], [], []
            for d, found in zip(batch.column(0).to_pylist(), coder.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.frombuffer(found, coder.wide).astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(d), no.append(k), start.append(at // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            columns = [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple, by: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece; sequences are numbered from 0."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    limits = np.array([capacity, max_docs, max_cost], float)
    demand = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    scale = np.asarray(weights, float) / limits**2
    order = np.argsort(-lengths, kind="stable")
    free, numbers, count, opened = np.zeros((n, 3)), np.zeros(n, np.int64), 0, 0
    smallest = lengths[order[-1]] if n else 0
    for step, i in enumerate(order):
        need = demand[i]
        if step % 512 == 511 and count:  # what can't take another piece is closed
            open_ = (free[:count, 0] >= smallest) & (free[:count, 1] >= 1) & (free[:count, 2] >= float(smallest) ** 2)
            kept = int(open_.sum())
            free[:kept], numbers[:kept] = free[:count][open_], numbers[:count][open_]
            count = kept
        at = -1
        if count and need[0] + smallest <= capacity:
            rest = free[:count] - need
            fits = rest.min(axis=1) >= 0
            if fits.any():
                score = -(rest**2 @ scale) if by == "norm" else ((limits - free[:count]) * need) @ scale
                at = int(np.where(fits, score, -np.inf).argmax())
        if at < 0:
            at, count = count, count + 1
            free[at], numbers[at], opened = limits, opened, opened + 1
        bins[i], offsets[i] = numbers[at], capacity - int(free[at, 0])
        free[at] -= need
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    by: str = "norm",
    group_size: int = 8192,
    keep_ids: bool = False,
    cached_words: int = 1_200_000,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset): one row a piece.

    ``max_docs`` pieces and ``max_cost`` (the sum of squared lengths) bound a sequence besides
    ``capacity`` tokens; left out, they never bind. A piece that alone exceeds ``max_cost`` has
    a sequence to itself. Null and empty texts are the end id alone; repeated rows are packed
    each; an empty table gives none. sequence_id is the group and the group's own number.
    ``cached_words`` bounds what a worker keeps between texts, some 240 bytes a word; fewer cost time.
    """
    path = tokenizer_path or default_path("word_bpe_49k.json")
    rows = materialize(token_pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids, cached_words), "token-pieces")
    groups = max(1, math.ceil(rows.count() / group_size))
    most, cost = max_docs or capacity, max_cost or capacity * capacity

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        number, offset = best_fit(group["length"].to_numpy(), capacity, most, cost, weights, by)
        first = group["packing_group"][0].as_py() << 32
        return group.drop_columns("packing_group").append_column("sequence_id", pa.array(first + number)).append_column("offset", pa.array(offset))

    # The row's number in the written table keeps repeated rows from being one group.
    dealt = rows.withColumn("packing_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("packing_group").applyInArrow(run, PIECES + ", ids binary" * keep_ids + ", sequence_id long, offset long")
