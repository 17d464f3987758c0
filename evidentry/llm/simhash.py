"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint is cut into ``blocks`` runs of bits. Two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` whole runs, so they share the bucket
of at least one choice of that many runs. Only distinct fingerprints enter buckets; copies
meet in a grouped minimum before. A bucket is read in sorted order and linked by a
breadth-first walk that gives at most one link a member instead of all pairs. Buckets over
``max_bucket`` members take an exact way whose cost grows with their members and not with
their square: any two members within the distance agree once some ``distance`` of the
remaining bits are cleared, so each member is dealt to all such masked values, and these
groups hold at most ``2 ** distance`` members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import key_filter, pieces, unused
from evidentry.llm.components import component_roots
from evidentry.session import materialize

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each of the text's word shingles, repeats included; of all words as one where they are fewer; without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have, as a signed long; of none zero."""
    if not len(hashes):
        return 0
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles, as a signed long; without words zero."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [fingerprint(x, width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.int64())], ["doc_id", "text_hash", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return plain.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(blocks: int, distance: int, known: int = 0) -> list[int]:
    """The bits (as signed longs) of every choice of ``blocks - distance`` runs of the bits that ``known`` hasn't, with those of ``known``."""
    known &= (1 << 64) - 1
    free = [k for k in range(64) if not known >> k & 1]
    edges = [round(len(free) * k / blocks) for k in range(blocks + 1)]
    runs = [sum(1 << k for k in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [_signed(known | sum(c)) for c in combinations(runs, blocks - distance)]


def _apart(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """How many bits differ; unsigned, as numpy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _walk(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the members as the graph of all pairs within the distance would."""
    links, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _apart(rest, at) <= distance
            if near.any():
                found = rest[near]
                links += [(int(at), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def _bucket_links(distance: int, limits: list[int]):
    """Rows sorted by (mask_no, key, fp) -> links; members of buckets beyond their mask's limit come back with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        large = None  # the key of a bucket that is known to be large

        def emit(links: list, big: np.ndarray | None) -> pa.RecordBatch:
            pairs = np.array(links, np.int64).reshape(-1, 2)
            extra = big if big is not None else np.zeros((0, 3), np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[pairs[:, 0], extra[:, 2]]),
                    pa.array(np.r_[pairs[:, 1], extra[:, 2]]),
                    pa.array(np.r_[np.full(len(pairs), -1), extra[:, 0]]),
                ],
                ["a", "b", "large_in"],
            )

        def close(rows: np.ndarray) -> tuple[list, np.ndarray | None]:
            nonlocal large
            change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts = np.r_[0, change]
            sizes = np.diff(np.r_[starts, len(rows)])
            links: list = []
            big = []
            two = starts[sizes == 2]
            a, b = rows[two, 2], rows[two + 1, 2]
            near = _apart(a, b) <= distance
            links += list(zip(a[near].tolist(), b[near].tolist()))
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if n > limits[rows[s, 0]]:
                    big.append(rows[s : s + n])
                else:
                    links += _walk(rows[s : s + n, 2], distance)
            return links, np.concatenate(big) if big else None

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
            if large is not None:
                same = (rows[:, :2] == large).all(axis=1)
                if same.any():
                    yield emit([], rows[same])
                    rows = rows[~same]
                if not len(rows):
                    continue
                large = None
            rows = np.concatenate([*held, rows]) if held else rows
            last = int(np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[-1])
            if last:
                yield emit(*close(rows[:last]))
            held = [rows[last:]]
            if len(held[0]) > limits[held[0][0, 0]]:
                large = held[0][0, :2].copy()
                yield emit([], held[0])
                held = []
        if held:
            yield emit(*close(held[0]))

    return run


#: Of fingerprints that agree in all but so many bits, more than a few thousand lie so close that a walk over them is short: such a bucket is walked whatever its size.
_FEW_BITS = 18


def fingerprint_links(distinct: DataFrame, distance: int = 3, blocks: int = 6, max_bucket: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within the distance.

    Pairs within the distance agree in ``blocks - distance`` runs of bits. The members of a bucket
    of more than ``max_bucket`` differ only in their other bits, so these are cut into runs and
    the members dealt to buckets again, until a bucket is small or few bits are left.
    """
    masks = block_masks(blocks, distance)
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("mask_no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    dealt, links = distinct.select("fp", F.explode(tables).alias("t")).select("t.mask_no", "t.key", "fp"), None
    while True:
        limits = [max_bucket if 64 - (m & (1 << 64) - 1).bit_count() > max(_FEW_BITS, distance) else 1 << 62 for m in masks]
        buckets = dealt.repartition("mask_no", "key").sortWithinPartitions("mask_no", "key", "fp")
        found = materialize(buckets.mapInArrow(_bucket_links(distance, limits), "a long, b long, large_in long"), "bucket-links")
        here = found.where("large_in < 0").select("a", "b")
        links = here if links is None else links.union(here)
        large = sorted(r[0] for r in found.where("large_in >= 0").select("large_in").distinct().collect())
        if not large:
            return links
        # Keys hold the bits that are known, so buckets of one mask need no key of the bucket they come from.
        finer = {i: block_masks(blocks, distance, masks[i]) for i in large}
        masks = [m for i in large for m in finer[i]]
        first = {i: sum(len(finer[j]) for j in large if j < i) for i in large}
        choice = F.coalesce(*(F.when(F.col("large_in") == i, F.array(*(F.struct(F.lit(first[i] + k).cast("long").alias("mask_no"), F.col("a").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(finer[i])))) for i in large))
        dealt = found.where("large_in >= 0").select(F.col("a").alias("fp"), F.explode(choice).alias("t")).select("t.mask_no", "t.key", "fp")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    distance: int = 3,
    blocks: int = 6,
    max_bucket: int = 20_000,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, group_id): one row for each row of ``docs``.

    component_id is the smallest doc_id in the component of fingerprints linked at ``distance``
    or fewer differing bits, itself included. Null, empty and blank texts have the fingerprint
    zero and are linked like any other. Repeated rows stay; a null doc_id keeps its links and
    gets the component's smallest doc_id (null if there is none). An empty table gives none.
    group_id is the component's own number, never null; text_hash tells a document's rows apart.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = component_roots(fingerprint_links(distinct.select("fp"), distance, blocks, max_bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.select("fp", "root").join(firsts, "root").select("fp", F.col("root").alias("group_id"), "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(members, "fp").select("doc_id", shown, "component_id", "text_hash", "group_id")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group_id of ``groups`` (doc_id, text_hash, group_id), with all its columns: that of the smallest doc_id, null ids last, then of the smallest text hash.

    Rows that are surely nobody's copy stay without a join; the others are asked for in the kept ones.
    """
    found = materialize(groups, "near-duplicates")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    own_id, own_hash = unused(docs, "kept_id", "kept_hash")
    kept = materialize(found.groupBy("group_id").agg(F.min(rank).alias("k")).select(F.col("k.doc_id").alias(own_id), F.col("k.text_hash").alias(own_hash)), "kept")
    is_kept = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col("text_hash") == F.col(own_hash))
    dropped = materialize(found.join(kept, is_kept, "left_anti").select("doc_id", "text_hash").distinct(), "dropped")
    may_go = key_filter(dropped, F.struct("doc_id", "text_hash"), F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")), dropped.count())
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    out = docs.where(~may_go).union(docs.where(may_go).join(kept, same, "left_semi"))
    repeats = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    if not repeats:
        return out
    return out.withColumn(own_hash, F.xxhash64(text_col)).dropDuplicates([id_col, own_hash]).drop(own_hash)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest doc_id, null ids last, then of the smallest text hash."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, **how).select("doc_id", "text_hash", "group_id"), id_col, text_col)
