"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams inside tasks and sums them by language and bucket; the counts form a
matrix of ``buckets`` x languages, whose size the rows don't change. Its logarithms are
broadcast, and texts are scored as sparse batches in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """The buckets of the text's lower-cased n-grams; runs of what aren't letters count as one space. No letter: none."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.r_[np.uint32(32), points[keep], np.uint32(32)].astype(np.uint32)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            size = len(points) - n + 1
            h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ points[k : k + size]) * _MIX[k]
                h ^= h >> np.uint32(15)
            out.append((h & np.uint32(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # BUCKETS x languages, float32
    log_prior: np.ndarray

    def predict(self, text: str | None, evidence: int = 200) -> tuple[str, float]:
        """The likeliest language and its posterior, the evidence counting as that of ``evidence`` n-grams at most."""
        grams = ngrams(text) if text else np.zeros(0, np.int64)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        if len(grams) > BUCKETS:
            like = np.bincount(grams, minlength=BUCKETS) @ self.log_prob.astype(float)
        else:
            like = self.log_prob[grams].sum(axis=0, dtype=float)
        best = int((like + self.log_prior).argmax())
        scaled = like * min(1.0, evidence / len(grams)) + self.log_prior
        share = np.exp(scaled - scaled.max())
        return self.languages[best], float(share[best] / share.sum())


def bounded_sample(labelled: DataFrame, label: str, keys: list[str], most: int, labels: int = 256) -> DataFrame:
    """About ``most`` rows of each label at most, chosen by a hash of ``keys``; all rows of labels with fewer.

    More than ``labels`` distinct labels are an error that names some of those beyond, by frequency.
    """
    counts = labelled.groupBy(label).count()
    found = counts.orderBy(F.desc("count"), label).limit(labels + 20).collect()
    if len(found) > labels:
        raise ValueError(f"more than {labels} labels to learn; among those beyond are {', '.join(str(r[0]) for r in found[labels:])}")
    shares = [(value, min(1.0, most / n)) for value, n in found]
    if not shares:
        return labelled
    chosen = labelled.sparkSession.createDataFrame(shares, labelled.select(F.col(label).alias("of_label"), F.lit(1.0).alias("share")).schema)
    sampled = labelled.join(F.broadcast(chosen), F.col(label) == F.col("of_label"))  # as many rows as ``labels``
    return sampled.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("of_label", "share")


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_docs: int = 20_000, max_labels: int = 256, smoothing: float = 0.1) -> LanguageModel:
    """Learns from rows with a label and a text that has a letter.

    ``max_docs`` bounds the rows of each label, chosen by a hash of the id and the text: a
    documented sample, taken only where there are more. More than ``max_labels`` labels are an
    error. Counts that reach the driver are at most 65,537 numbers a label. Without rows the
    model knows no language.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    rows = bounded_sample(rows.where("label IS NOT NULL AND text IS NOT NULL"), "label", ["doc_id", "text"], max_docs, max_labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def summed() -> Iterator[pa.RecordBatch]:
            for label, total in counts.items():
                at = np.flatnonzero(total)
                n = np.r_[total[at], docs[label]]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(n)), pa.array(np.r_[at, -1]), pa.array(n)], ["label", "bucket", "n"])
            counts.clear()

        for batch in pieces(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = ngrams(text)
                if len(grams):
                    if label not in counts:
                        if len(counts) == 32:  # 16 MB of counts
                            yield from summed()
                        counts[label], docs[label] = np.zeros(BUCKETS, np.int64), 0
                    counts[label] += np.bincount(grams, minlength=BUCKETS)
                    docs[label] += 1
        yield from summed()

    # A task gives no more numbers than its share of the bounded sample has n-grams.
    counted = rows.select("label", "text").mapInArrow(run, "label string, bucket long, n long")
    found = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, own = np.unique(np.array(found["label"].to_pylist(), object).astype(str), return_inverse=True)
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    counts, docs = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    docs[own[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], own[bucket >= 0]] = n[bucket >= 0]
    counts += smoothing
    return LanguageModel(tuple(map(str, names)), np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(docs / max(1, docs.sum())))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row for each row of ``docs``, repeats included.

    ``und`` with score 0 where the text is null, empty or has no letter, or the model knows no
    language. The text alone decides. An empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double")


def known_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language the model can tell: those predicted ``und`` go.

    These are null and empty texts and those without a letter. Repeated rows stay, each by its
    own text; columns of any name pass through; an empty table gives none. A model that knows
    no language can't tell any; then the rows whose text has a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = batch.column(at).to_pylist()
            if shared.value.languages:
                keep = [shared.value.predict(t)[0] != UNKNOWN for t in texts]
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
