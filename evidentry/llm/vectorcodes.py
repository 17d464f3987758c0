"""Codes of vectors: each of four parts by its nearest codebook entry, found in a vantage-point tree.

All arithmetic that decides anything is on integers. The codebooks are fitted by rounds of
assignment and averaging over all vectors; a round sends one row of sums for each entry and task
to a grouped sum, and only the entries' totals (parts x entries) reach the driver.

The tree over the entries of one part position splits them by their distance from a vantage
entry. A search descends the nearer side first and leaves out a side only if the triangle
inequality, with both distances rounded against leaving out, puts all of it farther than the
best entry so far; a side at an equal distance is visited, as it may hold a lower index. Which
entry is nearest is then decided on exact squared distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.session import discard, materialize

SCALE = 1024
#: Relative slack of rounded distances: more than the errors of a conversion, a root and a sum of doubles together.
_SLACK = 2.0**-48
_LEAF = 32
_SLICE = 1 << 13


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points and entries, both integers; by doubles where every sum stays below 2^53."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, points.shape[1]) < 1 << 53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    return np.stack([((points - x) ** 2).sum(axis=1) for x in entries], axis=1)


@dataclass
class _Node:
    entries: np.ndarray  # indexes, ascending; in an inner node the vantage entry alone
    sides: list[tuple[float, float, _Node]] = field(default_factory=list)  # least and largest distance from the vantage entry, rounded outwards; the nearer side first


class VantageTree:
    """Nearest entry by squared distance, the lowest index among equals."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._built(np.arange(len(entries))) if len(entries) else None

    def _built(self, members: np.ndarray) -> _Node:
        if len(members) <= _LEAF:
            return _Node(members)
        own = squared(self.entries[members], self.entries[members])
        at = int(np.argmax(own.max(axis=1)))  # an entry at the rim tells the others best apart
        rest, far = np.delete(members, at), np.delete(own[at], at)
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        node = _Node(members[at : at + 1])
        for side in (order[:half], order[half:]):
            roots = np.sqrt(far[side].astype(np.float64))
            node.sides.append((roots.min() * (1 - _SLACK), roots.max() * (1 + _SLACK), self._built(np.sort(rest[side]))))
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))

        def meet(node: _Node, who: np.ndarray) -> np.ndarray:
            """Compares the points with the node's own entries, exactly; returns the last entry's distances."""
            near = squared(points[who], self.entries[node.entries])
            k = near.argmin(axis=1)  # the first among equals
            least = near[np.arange(len(who)), k]
            better = (least < best[who]) | (least == best[who]) & (node.entries[k] < index[who])
            best[who[better]], index[who[better]] = least[better], node.entries[k[better]]
            return near[:, -1]

        def visit(node: _Node, who: np.ndarray) -> None:
            if not len(who):
                return
            far = np.sqrt(meet(node, who).astype(np.float64))
            if not node.sides:
                return
            inner_first = far <= (node.sides[0][1] + node.sides[1][0]) / 2
            for group, order in ((inner_first, (0, 1)), (~inner_first, (1, 0))):
                for k in order:
                    low, high, side = node.sides[k]
                    reach = np.sqrt(best[who].astype(np.float64)) * (1 + _SLACK)
                    open_ = group & (far * (1 + _SLACK) + reach >= low) & (far * (1 - _SLACK) - reach <= high)
                    visit(side, who[open_])

        if self.root:
            visit(self.root, np.arange(len(points)))
        return index, best


def _largest(width: int) -> int:
    """Components up to this have squared distances that fit 64 bits, sums of sixteen thousand of them included."""
    return int(min(2**31 - 1, (2.0**61 / max(1, 4 * width)) ** 0.5))


def integer_vectors(rows: DataFrame, vector_col: str, *others: str, scale: int = SCALE) -> DataFrame:
    """``others`` and ``v``, the vector as array<int> of floor(scale * x); without rows whose vector is null or holds null or non-finite components.

    Vectors of unequal lengths, and components too large for exact 64-bit distances (some
    9 * 10^4 at 64 components and a scale of 1024), fail with an error that says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                column = part.column(part.num_columns - 1)
                sizes = np.where(column.is_valid(), column.value_lengths().fill_null(0), 0)
                ends = np.cumsum(sizes)
                flat = np.floor(column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
                bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
                keep = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - sizes])
                whole = np.repeat(keep, sizes)
                limit = _largest(int(sizes.max(initial=0)))
                if (np.abs(flat[whole]) > limit).any():
                    raise ValueError(f"a component times {scale} is beyond {limit}: distances would not fit 64 bits")
                ints = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes[keep])].astype(np.int32)), pa.array(flat[whole].astype(np.int32)))
                kept = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(kept.num_columns - 1)), ints], [*others, "v"])

    plain = rows.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return plain.mapInArrow(run, plain.select(*(f"`{c}`" for c in others), F.col("v").cast("array<int>")).schema)


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """The vectors of a batch as (rows, parts, components of a part)."""
    sizes = column.value_lengths().to_numpy()
    if len(sizes) and (sizes.min() != sizes.max() or sizes[0] != parts * width):
        raise ValueError(f"all vectors must have {parts * width} components; found {sizes.min()} to {sizes.max()}")
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), parts, width)


def assigned(vectors: DataFrame, books: np.ndarray, *others: str) -> DataFrame:
    """``others``, codes (array<int>, the entry of each part) and error (long: squared distances, summed over the parts)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                v = _parts(part.column(part.num_columns - 1), parts, width)
                found = [t.nearest(v[:, k]) for k, t in enumerate(trees)]
                codes = np.stack([i for i, _ in found], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), lists, pa.array(sum(d for _, d in found))], [*others, "codes", "error"])

    plain = vectors.select(*(f"`{c}`" for c in others), "v")
    return plain.mapInArrow(run, plain.select(*(f"`{c}`" for c in others), F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).schema)


def _sums(vectors: DataFrame, books: np.ndarray) -> list:
    """(part, entry, count, sums) over all vectors: a row for each entry and task is shuffled, parts x entries rows are collected."""
    parts, _, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(b) for b in books]
        totals = np.zeros((parts, books.shape[1], width + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                v = _parts(batch.column(0).slice(at, _SLICE), parts, width)
                for k, t in enumerate(trees):
                    index, _ = t.nearest(v[:, k])
                    order = np.argsort(index, kind="stable")
                    met, starts = np.unique(index[order], return_index=True)
                    totals[k, met, 0] += np.diff(np.r_[starts, len(order)])
                    if width:
                        totals[k, met, 1:] += np.add.reduceat(v[order, k], starts, axis=0)
        k, e = np.nonzero(totals[:, :, 0])
        columns = [pa.array(k.astype(np.int32)), pa.array(e.astype(np.int32)), *(pa.array(totals[k, e, i]) for i in range(width + 1))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *names])

    schema = ", ".join(["part int", "entry int", "n long", *(f"{s} long" for s in names)])
    # Decimals, as the totals of all tasks may pass 64 bits where those of one do not.
    total = [F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in ("n", *names)]
    return vectors.select("v").mapInArrow(run, schema).groupBy("part", "entry").agg(*total).collect()


def fitted(vectors: DataFrame, id_col: str, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray | None:
    """Codebooks as (parts, entries, components): from the vectors of the smallest ids, by rounds of assignment and floored means.

    An entry that no part is assigned to stays. Fewer vectors than ``entries`` make shorter
    codebooks; no vector, None.
    """
    first = vectors.select(F.col(f"`{id_col}`").alias("id"), "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    sizes = {len(r.v) for r in first}
    if len(sizes) > 1 or (size := sizes.pop()) % parts:
        raise ValueError(f"all vectors must have one length that {parts} parts divide")
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, size // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds):
        for row in _sums(vectors, books):
            books[row[0], row[1]] = [int(s) // int(row[2]) for s in row[3:]]
    return books


def books_text(books: np.ndarray) -> str:
    """All entries' components as decimals, by part, entry and position, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, codes, error, label_error) of the kept rows, and the codebooks that the codes point into.

    Rows whose vector is null or holds null or non-finite components are left out; others stay,
    repeated ones too. Equal ids come into the first codebook by their vectors' order, null ids
    after all others. Empty vectors have codes of zeros and no error. label_error is the error
    summed over the rows of a label, null labels together. No kept row: no rows, and None. All
    vectors must have one length that ``parts`` divide, else the job fails and says so.
    """
    plain = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    vectors = materialize(integer_vectors(plain, "vector", "id", "label", scale=scale), "vectors")
    books = fitted(vectors, "id", parts, entries, rounds)
    if books is None:
        none = vectors.select("id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, None
    codes = materialize(assigned(vectors, books, "id", "label"), "vector-codes")
    discard(vectors)
    # Sums come together from all tasks before they meet the rows; a frequent label's rows are not shuffled to one place.
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("own")), "left").drop("own"), books


def restored(codes: DataFrame, books: np.ndarray, codes_col: str = "codes") -> DataFrame:
    """``codes`` with ``restored`` (array<int>): the entries that the codes name, end to end; null where the codes are."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(codes_col)).to_pylist()
            values = [None if c is None else books[np.arange(parts), c].ravel().tolist() for c in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.int32()))], [*batch.schema.names, "restored"])

    return codes.mapInArrow(run, codes.withColumn("restored", F.lit(None).cast("array<int>")).schema)


def books_sha256(books: np.ndarray | None) -> str:
    return hashlib.sha256((books_text(books) if books is not None else "").encode()).hexdigest()
