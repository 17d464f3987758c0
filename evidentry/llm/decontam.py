"""Benchmark decontamination: a prefix-filtered set join, verified by exact windows.

A benchmark item's windows of ``window`` consecutive words are sets of word shingles. Shingles
are ordered by how often they occur in the documents, all of which are counted; as a window
must be contained whole, its necessary prefix is its rarest shingle. Documents join the
windows on that shingle; positional and length bounds drop windows that would not fit, and
the words themselves are compared last.

Windows and prefixes are tables made in tasks. Workers need a benchmark's words and shingle
numbers to know which of a document's shingles matter: those are broadcast, for blocks of
items of about ``block_bytes`` of text at a time (a hash deals items to blocks), so that a
broadcast stays within a few times that size; a larger benchmark takes more blocks, each over
all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces, unused
from evidentry.session import materialize

WIDTH = 3
#: A-Z to a-z; digits, a-z and all bytes of characters outside ASCII stay; all else becomes a space.
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_A, _B = np.int64(-7046029254386353131), np.int64(-4417276706812531889)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text after lower-casing A-Z; as every separator is ASCII, bytes can be mapped one by one."""
    return text.encode().translate(_ASCII).split() if text else []


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each shingle of ``width`` words; windows are compared by words, so that collisions cost time only."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = ids[:n].astype(np.int64) + np.int64(width)
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out = (out ^ (out >> np.int64(29))) * _A + ids[k : k + n].astype(np.int64) * _B
    return out


def _number(word: bytes) -> int:
    """A word's number, never 0."""
    return (xxhash.xxh64_intdigest(word) >> 1) or 1


class _Known:
    """What a worker has to know of a benchmark block: its words' numbers, the widths of its shingles, and the sorted shingles that matter."""

    def __init__(self, words: list[bytes], widths: list[int], codes: np.ndarray):
        self.number = {w: _number(w) for w in words}
        self.widths, self.codes = widths, codes

    def shingles(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of a document's shingles that matter."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths if len(self.codes) else ():
            n = len(ids) - width + 1
            if n <= 0:
                continue
            full = ids[:n] != 0
            for k in range(1, width):
                full &= ids[k : k + n] != 0
            at = np.flatnonzero(full)
            if not len(at):
                continue
            code = _codes(ids, width)[at]
            spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[spot] == code
            places.append(at[hit]), found.append(code[hit])
        return np.concatenate(places), np.concatenate(found)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, words, codes): each distinct window of each item, with its shingles' numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[list] = [[], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                ids = np.array([_number(w) for w in words], np.int64)
                size = min(window, len(words))
                width = min(WIDTH, size)
                codes = _codes(ids, width) if words else ids
                for at in range(len(words) - size + 1 if words else 0):
                    for c, v in zip(out, (item, size, b" ".join(words[at : at + size]).decode(), codes[at : at + size - width + 1])):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["item_id", "size", "words", "codes"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, size long, words string, codes array<long>").distinct()


def _rarity(texts: DataFrame, known: _Known) -> DataFrame:
    """(code, n): how often each shingle that matters occurs in all documents; those that never do are absent."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known.codes), np.int64)
        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                _, codes = known.shingles(words_of(text))
                np.add.at(total, np.searchsorted(known.codes, codes), 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known.codes[found]), pa.array(total[found])], ["code", "n"])

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _prefixes(windows: DataFrame, rarity: DataFrame) -> DataFrame:
    """(code, item_id, offset, size, words): each window under its rarest shingle; windows with a shingle that occurs nowhere are out."""
    shingles = windows.select("item_id", "size", "words", F.posexplode("codes").alias("offset", "code"))
    counted = shingles.join(rarity, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("item_id", "size", "words").agg(F.min(F.struct("n", "offset", "code")).alias("k")).where("k.n > 0")
    return rarest.select("k.code", "item_id", F.col("k.offset").cast("long").alias("offset"), "size", "words")


def _longs(df: DataFrame, name: str) -> np.ndarray:
    """The sorted distinct values of a column of longs; for columns of a benchmark block."""
    return np.sort(df.select(name).distinct().toArrow()[name].to_numpy())


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(row, doc_id, text_hash, n_words, hits, items): one row for each row of ``docs``.

    hits has the distinct positions of words inside any window's occurrence, items the distinct
    item_ids with occurring windows as sorted strings. Null texts, of documents or items, have
    no words and no windows; repeated items count once. Repeated rows of ``docs`` stay apart
    under ``row``. An empty table of documents gives none; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    if blocks > 1:  # the rows' numbers have to be the same for every block
        texts = materialize(texts, "numbered-texts")
    found = None
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        windows = materialize(_windows(here, window), "benchmark-windows")
        words = [w.encode() for w in windows.select(F.explode(F.split("words", " ")).alias("w")).distinct().toArrow()["w"].to_pylist()]
        widths = [min(WIDTH, r[0]) for r in windows.select("size").distinct().collect()]  # at most ``window`` sizes
        known = _Known(words, sorted(set(widths)), _longs(windows.select(F.explode("codes").alias("code")), "code"))
        prefixes = materialize(_prefixes(windows, _rarity(texts, known)), "benchmark-prefixes")
        known.codes = _longs(prefixes, "code")
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """A row for each document, then one for each of its shingles that is some window's prefix, with the words around it."""
            known = shared.value
            for batch in pieces(batches):
                out: list[list] = [[] for _ in range(8)]
                for row, doc, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
                    words = words_of(text)
                    for c, v in zip(out, (row, doc, mark, len(words), None, None, None, None)):
                        c.append(v)
                    at, code = known.shingles(words)
                    for p, k in zip(at.tolist(), code.tolist()):
                        low = max(0, p - window + 1)
                        for c, v in zip(out, (row, doc, mark, len(words), k, p, low, [w.decode() for w in words[low : p + window]])):
                            c.append(v)
                kinds = [pa.int64()] * 7 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["row", "doc_id", "text_hash", "n_words", "code", "at", "low", "near"])

        rows = materialize(texts.mapInArrow(run, "row long, doc_id long, text_hash long, n_words long, code long, at long, low long, near array<string>"), "benchmark-rows")
        first = F.col("at") - F.col("offset")
        fits = (first >= 0) & (first + F.col("size") <= F.col("n_words")) & (first >= F.col("low"))
        same = F.array_join(F.slice("near", (first - F.col("low") + 1).cast("int"), F.col("size").cast("int")), " ") == F.col("words")
        kept = ["row", "doc_id", "text_hash", "n_words", "item_id", "size"]
        met = rows.where("code IS NOT NULL").join(prefixes, "code").select(*kept, F.when(fits, F.when(same, first)).alias("first")).where("first IS NOT NULL")
        # The documents' own rows take no part in the join: all their codes are null.
        own = rows.where("code IS NULL").select(*kept[:4], *(F.lit(None).cast("long").alias(c) for c in ("item_id", "size", "first")))
        found = met if found is None else found.union(met)
        found = found.union(own) if not block else found
    hit = F.when(F.col("first").isNotNull(), F.struct("first", "size"))
    grouped = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.collect_set(hit).alias("spans"),
        F.collect_set(F.when(F.col("first").isNotNull(), F.col("item_id").cast("string"))).alias("items"),
    )
    positions = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1))))
    return grouped.select("row", "doc_id", "text_hash", "n_words", positions.alias("hits"), F.array_sort("items").alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window.

    Null and empty texts hold none. Rows are told apart by id and text, null ids included, so
    repeated rows go or stay together. An empty benchmark drops nothing, an empty table gives none.
    """
    found = contaminated_words(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    own_id, own_hash = unused(docs, "hit_id", "hit_hash")
    hit = materialize(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct(), "contaminated")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_hash))
    return docs.join(hit, same, "left_anti")
