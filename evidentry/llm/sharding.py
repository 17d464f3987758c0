"""Shards by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that no shard border cuts. Groups enter, in decreasing
size, the bin whose remaining capacity is the tightest that holds them, found in a balanced
tree of remaining capacities. To keep every step bounded at any number of groups, packing
has two levels: small groups are packed into pallets inside hashed cells, by one task a
cell, and pallets and large groups are then packed into shards. A pallet holds at most
``1 / pallets_per_shard`` of a shard, so the second level has a number of units that follows
the number of shards and not the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.session import materialize


class CapacityTree:
    """Remaining capacities of bins in a balanced tree: each node has 64 children and a word of which are in use.

    The tree's height follows the largest capacity alone, so it never needs rebalancing.
    """

    def __init__(self, largest: int):
        self.levels: list[dict[int, int]] = [{}]
        while largest >> (6 * len(self.levels)):
            self.levels.append({})
        self.bins: dict[int, list[int]] = {}

    def add(self, remaining: int, number: int) -> None:
        stack = self.bins.setdefault(remaining, [])
        stack.append(number)
        if len(stack) == 1:
            for words in self.levels:
                remaining, bit = remaining >> 6, 1 << (remaining & 63)
                words[remaining] = words.get(remaining, 0) | bit

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of ``size`` or more."""
        at = size
        for level, words in enumerate(self.levels):
            word = words.get(at >> 6, 0) >> (at & 63)
            if word:
                at += (word & -word).bit_length() - 1
                for below in reversed(self.levels[:level]):
                    word = below[at]
                    at = (at << 6) + (word & -word).bit_length() - 1
                return at
            at = (at >> 6) + 1
        return None

    def take(self, remaining: int) -> int:
        stack = self.bins[remaining]
        number = stack.pop()
        if not stack:
            del self.bins[remaining]
            for words in self.levels:
                remaining, bit = remaining >> 6, 1 << (remaining & 63)
                words[remaining] &= ~bit
                if words[remaining]:
                    break
                del words[remaining]
        return number


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, bins numbered from 0. What exceeds the capacity has a bin to itself."""
    tree, out, opened = CapacityTree(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        remaining = tree.tightest(size) if size <= capacity else None
        if remaining is None:
            number, remaining, opened = opened, max(capacity, size), opened + 1
        else:
            number = tree.take(remaining)
        out[i] = number
        if size < remaining:
            tree.add(remaining - size, number)
    return out


def balanced(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Packs into at most ``shards`` bins of the smallest capacity for which best fit succeeds.

    A unit larger than its share has a shard to itself; the others share what remains.
    """
    order = np.argsort(-sizes, kind="stable")
    alone, rest = 0, int(sizes.sum())
    while alone < min(len(sizes), shards - 1) and sizes[order[alone]] > rest / (shards - alone):
        rest -= int(sizes[order[alone]])
        alone += 1
    out = np.zeros(len(sizes), np.int64)
    out[order[:alone]] = np.arange(alone)
    others, left = order[alone:], shards - alone
    if len(others):
        low, high = math.ceil(rest / left), rest
        best = np.zeros(len(others), np.int64)
        while low < high:
            capacity = (low + high) // 2
            found = best_fit_decreasing(sizes[others], capacity)
            if found.max() < left:
                high, best = capacity, found
            else:
                low = capacity + 1
        out[others] = best + alone
    return out


def shard_by_size(
    docs: DataFrame,
    shards: int | None = 8,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    pallets_per_shard: int = 512,
    cell_groups: int = 50_000,
    max_units: int = 2_000_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row for each row of ``docs``.

    Give ``shards`` for so many shards of near equal bytes, or ``capacity`` (and shards=None)
    for as few shards of at most so many bytes as best fit finds; a group larger than the
    capacity then has a shard to itself. size is the text's UTF-8 bytes plus 1; a null text
    has no bytes and shares the group of empty texts. slot numbers a shard's rows from 0
    without gaps. Repeated rows are rows of one group. An empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("text_key"),
        ),
        "sizes",
    )
    groups = materialize(light.groupBy("text_key").agg(F.sum("size").alias("bytes")), "groups")
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    share = capacity or max(1, math.ceil(total / shards))
    # The second level's units stay within max_units, down to 8 pallets a shard.
    pallet = max(1, share // max(8, min(pallets_per_shard, max_units * share // (total + share))))
    cells = max(1, math.ceil(n_groups / cell_groups))

    def load(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bytes", "descending"), ("text_key", "ascending")])
        cell, number = group["cell"][0].as_py(), best_fit_decreasing(group["bytes"].to_numpy(), pallet)
        return group.drop_columns("cell").append_column("unit", pa.array([f"{cell}:{n}" for n in number]))

    celled = groups.where(F.col("bytes") < pallet).withColumn("cell", F.pmod(F.xxhash64("text_key"), F.lit(cells)).cast("int"))
    small = celled.groupBy("cell").applyInArrow(load, "text_key string, bytes long, unit string")
    large = groups.where(F.col("bytes") >= pallet).select("text_key", "bytes", F.col("text_key").alias("unit"))
    placed = materialize(small.union(large), "pallets")
    # Units: at most 2 * pallets_per_shard a shard, and one part-filled pallet a cell.
    units = placed.groupBy("unit").agg(F.sum("bytes").alias("bytes")).orderBy("unit").toPandas()
    sizes = units["bytes"].to_numpy(np.int64)
    units["shard"] = (best_fit_decreasing(sizes, capacity) if capacity else balanced(sizes, shards)).astype(np.int32)
    shard_of = spark.createDataFrame([(u, int(s)) for u, s in zip(units["unit"], units["shard"])], "unit string, shard int")
    where = placed.join(shard_of, "unit").select("text_key", "shard")
    return with_slots(light.join(where, "text_key").select("doc_id", "size", "text_crc32", "shard"))


def with_slots(rows: DataFrame, slice_rows: int = 20_000) -> DataFrame:
    """Numbers the rows of each ``shard`` from 0: rows are dealt to slices, counted, and numbered inside slices.

    A row's slice comes from its number in the written table, so that rows of one id are in many.
    """
    rows = materialize(rows.withColumn("dealt", F.xxhash64(F.monotonically_increasing_id())), "sharded")
    slices = max(1, math.ceil(rows.count() / slice_rows))
    sliced = rows.withColumn("slice", F.pmod("dealt", F.lit(slices)).cast("int"))
    counts = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "slice", "sum(n) OVER (PARTITION BY shard ORDER BY slice) - n AS before")
    numbered = sliced.selectExpr("*", "row_number() OVER (PARTITION BY shard, slice ORDER BY doc_id, text_crc32, size) - 1 AS in_slice")
    joined = numbered.join(before, ["shard", "slice"])
    return joined.withColumn("slot", (F.col("before") + F.col("in_slice")).cast("long")).drop("dealt", "slice", "before", "in_slice")
