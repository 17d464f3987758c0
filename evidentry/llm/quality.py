"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word is hashed to one of ``BUCKETS`` rows. A row's context vector is the sum, over all
occurrences in all documents, of the sparse random index vectors of the words beside it. The
sums are made inside tasks and added up by row in Spark; their size depends on the table of
rows and not on the corpus. A document is the mean and the spread of its words' vectors. A
two-layer network in numpy learns from labelled documents, and a temperature fitted on rows
that it didn't learn from calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.llm.columns import pieces, utf8
from evidentry.llm.langid import bounded_sample
from evidentry.session import materialize

BUCKETS, DIM, NONZERO = 1 << 14, 32, 4
#: Bytes: 0 white space, 1 letters (all beyond ASCII too), 2 digits, 3 the rest.
_CLASS = np.array([0 if c <= 32 else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
_SHAPE = np.random.default_rng(7).integers(1, 1 << 62, (16, 256), np.uint64)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each row's places and signs in its sparse random index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word, and the word range of each text: runs of letters, digits or other marks, case kept."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    cut = np.empty(len(data), bool)
    cut[0] = True
    cut[1:] = kind[1:] != kind[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    with np.errstate(over="ignore"):
        mixed = _SHAPE[at & 15, data] * (2 * (at >> 4) + 1).astype(np.uint64)
        rows = np.add.reduceat(mixed, starts)
        rows = (rows ^ (rows >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)
    real = kind[starts] > 0
    starts = starts[real]
    return rows[real].astype(np.int64), np.searchsorted(starts, offsets)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM unit vectors from all documents; words that never occur have zeros.

    A task sends its own sums once, 4 MB at most whatever it read; the driver gets one table of that size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        total = np.zeros(BUCKETS * DIM)
        for batch in pieces(batches):
            data, offsets = utf8(batch.column(0))
            rows, ranges = words(data, offsets)
            text = np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))
            for k in (1, 2):
                same = text[k:] == text[:-k]
                left, right = rows[:-k][same], rows[k:][same]
                for a, b in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIM + places[b, j], signs[b, j], BUCKETS * DIM)
        sums = total.reshape(BUCKETS, DIM).astype(np.int64)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, d]) for d in range(DIM))], ["row", *(f"v{d}" for d in range(DIM))])

    schema = "row long, " + ", ".join(f"v{d} long" for d in range(DIM))
    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema)
    found = summed.groupBy("row").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM))).toPandas()
    out = np.zeros((BUCKETS, DIM))
    out[found["row"].to_numpy(np.int64)] = found[[f"v{d}" for d in range(DIM)]].to_numpy(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features): the mean and the spread of the vectors of a document's words, as little-endian float32."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in pieces(batches, limit=1 << 20):
            data, offsets = utf8(batch.column(1))
            rows, ranges = words(data, offsets)
            out = np.zeros((batch.num_rows, 2 * DIM), np.float32)
            for i, (a, b) in enumerate(zip(ranges, ranges[1:])):
                if a < b:
                    if b - a > BUCKETS:
                        n = np.bincount(rows[a:b], minlength=BUCKETS) / (b - a)
                        mean, square = n @ table, n @ table**2
                    else:
                        own = table[rows[a:b]]
                        mean, square = own.mean(axis=0), np.einsum("ij,ij->j", own, own) / (b - a)
                    out[i, :DIM], out[i, DIM:] = mean, np.sqrt(np.maximum(square - mean**2, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out.astype("<f4")], pa.binary())], ["doc_id", "features"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, features binary")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5) -> QualityModel:
    """Adam on the log loss; every fifth row is left for the temperature. Without both labels the score is the labels' share."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2 * DIM), np.ones(2 * DIM))
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    w2, b2 = np.zeros(hidden), np.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return QualityModel(mean, scale, w1, b1, w2, b2, 1.0)
    kept = np.arange(len(y)) % 5 > 0 if len(y) >= 50 else np.ones(len(y), bool)
    z, t = ((x - mean) / scale)[kept], y[kept].astype(float)
    w2 = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    parts = [w1, b1, w2, np.array([b2])]
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            rows = order[at : at + 256]
            h = np.tanh(z[rows] @ parts[0] + parts[1])
            error = (1 / (1 + np.exp(-(h @ parts[2] + parts[3]))) - t[rows]) / len(rows)
            back = np.outer(error, parts[2]) * (1 - h * h)
            slopes = [z[rows].T @ back + 1e-5 * parts[0], back.sum(axis=0), h.T @ error + 1e-5 * parts[2], np.array([error.sum()])]
            step += 1
            rate = 0.005 * (0.5 * (1 + np.cos(np.pi * epoch / epochs))) + 1e-4
            for p, g, m, v in zip(parts, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]), 1.0)
    check = ~kept if (~kept).any() else kept
    logits, truth = model.logits(x[check]), y[check].astype(float)
    loss = lambda s: np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / s).mean()
    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return QualityModel(mean, scale, parts[0], parts[1], parts[2], model.b2, float(best))


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_rows: int = 40_000) -> QualityModel:
    """Fits on at most ``max_rows`` distinct (id, features) of each label, those of the least hashes: the documented bound.

    So the driver gets ``2 * max_rows`` rows of 256 bytes at most, however often an id is repeated.
    Rows of hashes that can't be among the least are left out before they are ordered.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    joined = materialize(features.join(marked, "doc_id").select("doc_id", "features", "label").distinct(), "quality-labelled")
    thinned = bounded_sample(joined, "label", ["doc_id", "features"], max_rows + 6 * math.isqrt(max_rows) + 100)
    each = [thinned.where(F.col("label") == k).orderBy(F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 30)), "doc_id", "features").limit(max_rows) for k in (0, 1)]
    rows = each[0].union(each[1]).toPandas().sort_values(["doc_id", "label", "features"], kind="stable")
    x = np.frombuffer(b"".join(bytes(f) for f in rows["features"]), "<f4").reshape(-1, 2 * DIM).astype(float)
    return fit_network(x, rows["label"].to_numpy(np.int64))


def score(features: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score): the calibrated probability of label 1."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, 2 * DIM).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(x))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 40_000) -> DataFrame:
    """(doc_id, score): one row for each row of ``docs``, learned from all rows of ``labels`` given.

    Word vectors come from all documents. Null and empty texts have zero features and are
    scored as such; labels other than 0 and 1 aren't learned from; repeated rows are scored
    each. Without labels every score is 0.5. An empty table gives none.
    """
    vectors = context_vectors(docs, text_col)
    features = materialize(pooled(docs, vectors, id_col, text_col), "quality-features")
    return score(features, train(features, labels, label_col, id_col, max_rows))
