"""Minute rollups of log events, recomputed exactly for the minutes that a batch touched.

A rollup is never incremented. Every minute that changed is deleted and rebuilt from its
events, however late they are; there is no watermark that would drop any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.functions.texts import status_class
from evidentry.functions.times import Window, minute

KEYS = ("service_id", "bucket_start", "status_class", "level", "template_hash")
SEQUENCE_BITS = 56


def _tests(kind: Column) -> dict[str, Column]:
    """Whether a variant's schema is of a kind; no schema is of two."""
    return {
        "array": F.startswith(kind, F.lit("ARRAY")),
        "string": kind == "STRING",
        "number": kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"),
        "object": F.startswith(kind, F.lit("OBJECT")),
        "boolean": kind == "BOOLEAN",
        "null": kind == "VOID",
    }


def _schema(attrs: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(attrs), f"$.{key}", "variant"))


def json_kind(attrs: Column, key: str) -> Column:
    """array, string, number, object, boolean or null of a JSON text's key; no value where the key or the JSON is missing."""
    out = F
    for name, holds in _tests(_schema(attrs, key)).items():
        out = out.when(holds, name)
    return out


def is_kind(attrs: Column, key: str, kind: str) -> Column:
    """One test of the key, not a question for its kind, which would parse the text for each kind there is."""
    return F.coalesce(_tests(_schema(attrs, key))[kind], F.lit(False))


def richness(trace_id: Column, attrs: Column) -> Column:
    """0 to 5: how much an event tells about itself."""
    parts = [
        F.coalesce(trace_id != "", F.lit(False)),
        is_kind(attrs, "stack", "array"),
        is_kind(attrs, "upstream", "string"),
        is_kind(attrs, "duration_ms", "number"),
        is_kind(attrs, "exc_type", "string"),
    ]
    total = parts[0].cast("int")
    for p in parts[1:]:
        total = total + p.cast("int")
    return total


def packed_rank(rich: Column, sequence: Column) -> Column:
    """One long that orders by richness downwards, then by sequence: its minimum is a plain hash aggregate."""
    return F.shiftleft((F.lit(5) - rich).cast("long"), SEQUENCE_BITS).bitwiseOR(sequence.cast("long"))


def unpacked(rank: Column) -> Column:
    return rank.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1))


def rollup(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(service_id, bucket_start, status_class, level, template_hash, count, first_seen, last_seen, exemplar_id)."""
    rows = events.select(
        "service_id",
        (minute("ts") if bucket is None else bucket).alias("bucket_start"),
        status_class(F.col("status_code")).alias("status_class"),
        "level",
        "template_hash",
        "ts",
        packed_rank(richness(F.col("trace_id"), F.col("attrs")), F.col("id")).alias("rank"),
    )
    grouped = rows.groupBy(*KEYS).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("rank").alias("rank"))
    return grouped.withColumn("exemplar_id", unpacked(F.col("rank"))).drop("rank")


def dirty_minutes(changed: DataFrame, rollups: DataFrame | None = None) -> DataFrame:
    """The (service_id, bucket_start) pairs of changed events and of those rollups that already stand for them."""
    pairs = changed.select("service_id", minute("ts").alias("bucket_start")).distinct()
    if rollups is None:
        return pairs
    known = rollups.select("service_id", "bucket_start").join(pairs, ["service_id", "bucket_start"], "left_semi")
    return pairs.unionByName(known).distinct()


def checked_minutes(pairs: DataFrame) -> DataFrame:
    """Distinct (service_id, bucket_start) pairs that a caller names: a null, or an instant that no minute starts at, raises.

    ``bucket_start`` has to be an instant; a wall clock without a zone is refused.
    """
    kinds = dict(pairs.dtypes)
    if kinds["bucket_start"] != "timestamp":
        raise ValueError("bucket_start has to be an instant with a zone")
    if kinds["service_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("service_id has to be an integer")
    start = F.col("bucket_start")
    wrong = F.when(F.col("service_id").isNull() | start.isNull(), "a dirty pair has a null").when(F.unix_micros(start) % 60_000_000 != 0, "bucket_start has to be the start of a minute")
    return pairs.select("service_id", F.when(wrong.isNull(), start).otherwise(F.raise_error(wrong).cast("timestamp")).alias("bucket_start")).distinct()


def delete_minutes(rollups: DataFrame, dirty: DataFrame) -> DataFrame:
    return rollups.join(dirty, ["service_id", "bucket_start"], "left_anti")


def recompute(events: DataFrame, rollups: DataFrame, dirty: DataFrame) -> DataFrame:
    """The rollup table after the dirty minutes were deleted and rebuilt from ``events``.

    The dirty minutes' time range bounds the scan of events; the planner broadcasts the pairs
    only below its threshold.
    """
    span = dirty.agg(F.min("bucket_start").alias("low"), F.max("bucket_start").alias("high")).first()
    touched = events
    if span.low is not None:
        touched = events.where(Window(span.low, span.high).start <= F.col("ts")).where(F.col("ts") < F.lit(span.high) + F.expr("INTERVAL 1 MINUTE"))
    keyed = touched.withColumn("bucket_start", minute("ts")).join(dirty, ["service_id", "bucket_start"], "left_semi").drop("bucket_start")
    fresh = rollup(keyed)
    return delete_minutes(rollups, dirty).unionByName(fresh.select(*rollups.columns))
