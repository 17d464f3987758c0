"""Nearest incident reviews: exact cosine distance, the best chunk of each, its resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.functions import citations
from evidentry.functions.texts import snippet
from evidentry.functions.vectors import cosine_distance, literal

FLOOR = 0.65


def best_chunks(chunks: DataFrame, query: Sequence[float], floor: float = FLOOR) -> DataFrame:
    """The nearest chunk of each slug within the floor. The query vector is a constant: the search is a projection."""
    near = chunks.withColumn("distance", cosine_distance(F.col("embedding"), literal(query))).where(F.col("distance") <= floor)
    return near.groupBy("slug").agg(F.min_by(F.struct(*near.columns), F.struct("distance", "ordinal")).alias("best")).select("best.*")


def resolutions(chunks: DataFrame) -> DataFrame:
    return chunks.where("kind = 'resolution'").groupBy("slug").agg(F.min("ordinal").alias("resolution_ordinal"))


def search(postmortems: DataFrame, chunks: DataFrame, query: Sequence[float], k: int = 5, service: str | None = None, floor: float = FLOOR) -> DataFrame:
    """The ``k`` nearest documents by distance, slug and ordinal."""
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k must be a positive integer")
    docs = postmortems if service is None else postmortems.where(F.array_contains("services", service))
    hits = best_chunks(chunks, query, floor).join(docs, "slug").orderBy("distance", "slug", "ordinal").limit(k)
    hits = hits.join(resolutions(chunks), "slug", "left")
    return hits.select(
        citations.postmortem(F.col("slug"), F.col("content_sha"), F.col("ordinal")).alias("cite"),
        F.when(F.col("resolution_ordinal").isNotNull(), citations.postmortem(F.col("slug"), F.col("content_sha"), F.col("resolution_ordinal"))).alias("resolution_cite"),
        "slug",
        "title",
        "occurred_at",
        snippet(F.col("content")).alias("snippet"),
        "resolution_md",
        (1 - F.col("distance")).alias("similarity"),
    ).orderBy(F.desc("similarity"), "slug")
