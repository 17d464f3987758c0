"""JSON texts as VARIANT values: strict objects, the last of equal keys, typed fields, and ISO times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def _last_of_equal_keys(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take the last of equal keys; the rule is fixed in a plan when it is made, and the session keeps its own setting."""
    before = spark.conf.get(_DUPLICATES)
    spark.conf.set(_DUPLICATES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DUPLICATES, before)


def with_object(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` with the text's object as map<string, variant> in ``name``; null if it isn't one JSON object and nothing else.

    The parser leaves what follows a value unread. In brackets, a second value makes an array of
    two or of nothing valid, unless what follows begins with a bracket; such a text is asked for
    in braces too, where a bracket cannot go on. NaN and infinities, which JSON hasn't, are refused.
    """
    # What isn't in braces is no object; the parser would raise an error for it, which costs more than all else.
    text = F.when(text.rlike(r"\A[ \t\r\n]*+\{") & text.rlike(r"\}[ \t\r\n]*+\z"), text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    with _last_of_equal_keys(rows.sparkSession):
        parsed = rows.withColumn(name, listed)
        closes = text.rlike(r"\}\s*\]")
        alone = ~closes | F.coalesce(F.size(F.map_keys(held.try_cast("map<string,variant>"))) == 1, F.lit(False))
        only = F.when(F.size(F.col(name).try_cast("array<variant>")) == 1, F.get(F.col(name).try_cast("array<variant>"), F.lit(0)))
        return parsed.withColumn(name, F.when(alone, only.try_cast("map<string,variant>")))


def field(values: Column, key: str) -> Column:
    return F.element_at(values, F.lit(key))


def kind(values: Column, key: str) -> Column:
    """string, integer, number (any other), boolean, null, object or array; null where the key is missing."""
    return kind_of(F.schema_of_variant(field(values, key)))


def kind_of(schema: Column) -> Column:
    """The kind that a variant's schema says; the schema is best a plain column, as it is asked several times."""
    # Integers beyond a long are decimals of 19 digits or more; shorter decimals had a point.
    return (
        F.when(schema == "STRING", "string")
        .when(schema.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\((19|[23]\d),0\))$"), "integer")
        .when(schema.rlike(r"^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
    )


#: Calendar dates in both forms; after any one character a time in both forms, and an offset.
_ISO = (
    r"^(\d{4})(?:-(\d\d)-(\d\d)|(\d\d)(\d\d))"
    r"(?:[\s\S](\d\d)(?::(\d\d)(?::(\d\d))?|(\d\d)(\d\d)?)?(?:[.,](\d+))?(Z|[+-]\d\d(?::?\d\d(?::?\d\d(?:\.\d{1,6})?)?)?)?)?$"
)
#: The form that most logs use, in UTC or without an offset: read as it stands.
_USUAL = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z?\z"


def iso_time(text: Column) -> tuple[Column, Column]:
    """(microseconds since 1970 or null, whether no offset was given) of an ISO 8601 date and time; week dates are not taken."""
    usual = text.rlike(_USUAL)
    wall = F.replace(text, F.lit("Z"), F.lit("")).try_cast("timestamp_ntz")
    micros, naive = _any_iso_time(text)
    return F.when(usual, _micros(wall)).otherwise(micros), F.when(usual, ~F.endswith(text, F.lit("Z"))).otherwise(naive)


def _micros(wall: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01T00:00:00").cast("timestamp_ntz"), wall)


def _any_iso_time(text: Column) -> tuple[Column, Column]:
    part = lambda i: F.regexp_extract(text, _ISO, i)
    either = lambda i, j, zero="00": F.coalesce(F.nullif(part(i), F.lit("")), F.nullif(part(j), F.lit("")), F.lit(zero))
    fraction = F.substring(F.rpad(either(11, 11, "0"), 6, "0"), 1, 6)
    clock = F.concat_ws(":", F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")), either(7, 9), either(8, 10))
    shown = F.concat(F.concat_ws("-", part(1), either(2, 4), either(3, 5)), F.lit("T"), clock, F.lit("."), fraction)
    wall = F.when(text.rlike(_ISO) & (part(1) != "0000"), shown).try_cast("timestamp_ntz")
    zone = part(12)
    digits = F.regexp_replace(zone, r"[^0-9.]", "")
    piece = lambda at, size: F.coalesce(F.nullif(F.substring(digits, at, size), F.lit("")), F.lit("0")).try_cast("decimal(12,6)")
    seconds = piece(1, 2) * 3600 + piece(3, 2) * 60 + piece(5, 9)
    offset = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1) * (seconds * 1_000_000).cast("long"))
    return F.when(seconds < 86_400, _micros(wall) - offset), zone == ""
