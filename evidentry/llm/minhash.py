"""Near copies by word shingles: SimHash and MinHash candidates, exact Jaccard similarity to verify.

A document is the set of its five-word shingles. Documents of equal sets meet in a grouped
minimum. The first candidates are the links of :mod:`evidentry.llm.simhash`: fingerprints of
the same shingles that differ in 3 bits or fewer, found by pigeonhole blocks. At a similarity
of 0.8 fingerprints of 64 bits differ in about 10 bits, more than blocks can select by, so
the rest comes from MinHash: sets are dealt to ``BANDS`` buckets, each named by ``ROWS``
minima, and a pair of similarity s shares a bucket with probability 1 - (1 - s ** ROWS) **
BANDS: 0.99995 at 0.8 and more above. Every candidate pair is verified on the sets
themselves. First each bucket's members meet its hub, the one that shares buckets with most
others: a pair a member. Only sets that the verified links leave in different components of
one bucket go on, to a join of prefixes (:func:`prefix_pairs`), so that a bucket of copies,
or of texts that are loosely alike, isn't compared all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import key_filter, pieces
from evidentry.llm.components import component_roots
from evidentry.llm.simhash import SEED, fingerprint_links, majority, one_of_each, shingle_hashes
from evidentry.session import materialize

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2)
_FOLD = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; all its words as one where they are fewer; without words none."""
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray, step: int = 2048) -> np.ndarray:
    """The set's bucket in each band; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), step):
        np.minimum(least, (hashes[None, at : at + step] * _TIMES + _PLUS).min(axis=1), out=least)
    mixed = least.reshape(BANDS, ROWS) >> np.uint64(7)
    return (((mixed ^ (mixed >> np.uint64(29))) * _FOLD).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))


def _names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, set_hash, n, buckets): one row for each row of ``docs``; fp is the SimHash, n the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes = [shingle_hashes(x, WIDTH) for x in batch.column(1).to_pylist()]
            sets = list(map(np.unique, hashes))
            columns = [pa.array(list(map(majority, hashes)), pa.int64()), _names(sets), pa.array(list(map(len, sets)), pa.int32()), _lists([bands(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "text_hash", "fp", "set_hash", "n", "buckets"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, fp long, set_hash long, n int, buckets array<long>")


def shingle_sets(plain: DataFrame) -> DataFrame:
    """(set_hash, shingles) of each row of (doc_id, text, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([_names(sets), _lists(sets)], ["set_hash", "shingles"])

    return plain.mapInArrow(run, "set_hash long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that; ``sets`` has (set_hash, shingles) once each."""
    one = sets.select(F.col("set_hash").alias("a"), F.col("shingles").alias("of_a"))
    other = sets.select(F.col("set_hash").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(one, "a").join(other, "b").withColumn("n", F.size("of_a") + F.size("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.withColumn("shared", shared).where(F.col("shared") >= F.lit(similarity) * (F.col("n") - F.col("shared"))).select("a", "b")


def fingerprint_pairs(found: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of set hashes: sets of one SimHash with its smallest, and the smallest of linked ones."""
    sets = found.select("fp", "set_hash").distinct()
    firsts = materialize(sets.groupBy("fp").agg(F.min("set_hash").alias("first")), "distinct-fingerprints")
    alike = sets.join(firsts, "fp").where("first <> set_hash").select(F.col("first").alias("a"), F.col("set_hash").alias("b"))
    links = fingerprint_links(firsts.select("fp"))
    x, y = (firsts.select(F.col("fp").alias(n), F.col("first").alias(f"set_{n}")) for n in "ab")
    linked = links.join(x, "a").join(y, "b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
    return alike.union(linked).distinct()


def prefix_pairs(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) among the sets of ``rest`` (set_hash, n, root) with different roots: all that can be as similar as that.

    Shingles are ordered by how many of these sets have them. Two sets of that similarity share
    ``similarity / (1 + similarity)`` of their sizes' sum at least, so the smaller one's first
    shingles (all but what has to be shared with one of its own size, and one) and the larger
    one's (all but what the smallest possible partner shares, and one) have one in common. A set's
    shingles that no other has come first and meet nothing: only the others are moved.
    """
    share = similarity / (1 + similarity)
    least = lambda n: F.ceil(F.lit(share) * n - 1e-9)
    own = rest.join(sets, "set_hash").select("set_hash", F.explode("shingles").alias("shingle"))
    common = own.groupBy("shingle").agg(F.count("*").alias("n_sets")).where("n_sets > 1")
    ordered = own.join(common, "shingle").groupBy("set_hash").agg(F.array_sort(F.collect_list(F.struct("n_sets", "shingle"))).alias("common"))
    sized = ordered.join(rest, "set_hash").withColumn("alone", F.col("n") - F.size("common"))
    sized = sized.withColumn("reach", F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).withColumn("as_smaller", F.col("n") - least(2 * F.col("n")) + 1)
    first = F.slice("common", 1, F.greatest(F.col("reach") - F.col("alone"), F.lit(0)).cast("int"))
    met = sized.select("set_hash", "n", "root", "alone", "as_smaller", F.posexplode(first).alias("at", "s"))
    met = materialize(met.select("set_hash", "n", "root", (F.col("alone") + F.col("at")).alias("at"), "as_smaller", F.col("s.shingle").alias("shingle")), "prefixes")
    x, y = met.where("at < as_smaller").alias("x"), met.alias("y")
    larger = F.struct("x.n", "x.set_hash") < F.struct("y.n", "y.set_hash")
    fits = F.col("x.n") >= F.lit(similarity) * F.col("y.n") - 1e-9
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # what they can share from here on
    enough = left >= least(F.col("x.n") + F.col("y.n"))
    both = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & larger & fits & enough)
    return both.select(F.least("x.set_hash", "y.set_hash").alias("a"), F.greatest("x.set_hash", "y.set_hash").alias("b")).distinct()


def set_links(found: DataFrame, plain: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between set hashes whose components are those of all candidate pairs as similar as that.

    ``found`` has the signatures of ``plain`` (doc_id, text, text_hash). Sets are made again for
    members of shared buckets only, which is less to write than the sets of all.
    """
    dealt = found.select("set_hash", "n", F.explode("buckets").alias("bucket")).distinct()
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(dealt.join(shared, "bucket"), "band-members")
    near = materialize(fingerprint_pairs(found), "fingerprint-pairs")
    named = members.select("set_hash").union(near.select("a")).union(near.select("b")).distinct()
    chosen = found.join(named, "set_hash", "left_semi").groupBy("set_hash").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    chosen = materialize(chosen.select(F.col("k.doc_id").alias("of_id"), F.col("k.text_hash").alias("of_hash")), "band-texts")
    wanted = key_filter(chosen, F.struct(F.col("of_id").alias("doc_id"), F.col("of_hash").alias("text_hash")), F.struct("doc_id", "text_hash"), chosen.count())
    texts = plain.where(wanted).join(chosen, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left_semi")
    sets = materialize(shingle_sets(texts).groupBy("set_hash").agg(F.any_value("shingles").alias("shingles")), "band-sets")
    company = members.groupBy("set_hash").agg(F.sum("members").alias("company"))
    hubs = members.join(company, "set_hash").groupBy("bucket").agg(F.max_by("set_hash", F.struct("company", "set_hash")).alias("hub"))
    to_hub = members.join(hubs, "bucket").where("set_hash <> hub").select(F.least("hub", "set_hash").alias("a"), F.greatest("hub", "set_hash").alias("b"))
    links = materialize(_verified(materialize(to_hub.union(near).distinct(), "hub-pairs"), sets, similarity), "hub-links")
    roots = component_roots(links)
    labelled = members.join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").select("bucket", "set_hash", "n", F.coalesce("root", "set_hash").alias("root"))
    labelled = materialize(labelled, "band-roots")
    apart = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rest = materialize(labelled.join(apart, "bucket").select("set_hash", "n", "root").distinct(), "apart")
    return links.union(_verified(prefix_pairs(rest, sets, similarity), sets, similarity))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, group_id): one row for each row of ``docs``, the group that of its shingle set's component.

    Texts without words share the empty set. Repeated rows stay; an empty table gives none.
    """
    found = materialize(signatures(docs, id_col, text_col), "signatures")
    roots = component_roots(set_links(found, _plain(docs, id_col, text_col), similarity)).withColumnRenamed("node", "set_hash")
    return found.select("doc_id", "text_hash", "set_hash").join(roots, "set_hash", "left").select("doc_id", "text_hash", F.coalesce("root", "set_hash").alias("group_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns, chosen as :func:`one_of_each` does."""
    return one_of_each(docs, near_copies(docs, id_col, text_col, similarity), id_col, text_col)
