"""Log formats: detection by a sample of each file, and parsers that turn lines into drafts.

A format is a name, a test of a single line, and a function from lines to parsed records; the
registry's order breaks ties. Parsed records then go one common way: service lookup, zone,
level, template, identity. A record that can't be used keeps its text and gets a reason.
"""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentry.functions.identity import log_uid
from evidentry.functions.jsonvalues import field, iso_time, kind_of, with_object
from evidentry.functions.texts import canonical_level, component, mask, nfc, template_hash
from evidentry.functions.times import attach_zone
from evidentry.session import materialize
from evidentry.sources.rawlines import text_of
from evidentry.sources.records import HEADER, PARSED, micros_of, parse_tracebacks, record

SAMPLE = 20
CONSUMED = {"ts", "level", "service", "msg", "trace_id", "status", "duration_ms"}

#: The formats' patterns.
NGINX = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]+" (\d{3}) \S+ "[^"]*" "[^"]*"(?: rt=(\S+))?(?: urt="([^"]*)")?\s*$'


@dataclass(frozen=True)
class LogFormat:
    """``probe`` tells whether a line looks like the format; ``parse`` maps (source_file, source_offset, raw, declared) to those and ``p``.

    A ``raw_aware`` format is given the line's own bytes besides, as raw_bytes.
    """

    name: str
    probe: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame]
    raw_aware: bool = False


def best_format(lines: DataFrame, probes: Mapping[str, Column]) -> DataFrame:
    """(source_file, format): what most of a file's first non-blank lines look like; the earlier of equal formats."""
    place = F.row_number().over(W.partitionBy("source_file").orderBy("source_offset"))
    sample = lines.where(F.col("raw").rlike(r"\S")).withColumn("place", place).where(F.col("place") <= SAMPLE)
    shares = [F.avg(F.coalesce(p, F.lit(False)).cast("int")).alias(n) for n, p in probes.items()]
    ranked = F.array(*[F.struct(F.col(n).alias("share"), F.lit(-i).alias("first"), F.lit(n).alias("format")) for i, n in enumerate(probes)])
    return sample.groupBy("source_file").agg(*shares).select("source_file", F.array_max(ranked)["format"].alias("format"))


def _fields(values: dict[str, str]) -> dict[str, Any]:
    """A message and a time are needed; durations, which are text here, and odd statuses are named in coercion_dropped."""
    message, ts = values.get("msg"), values.get("ts")
    if not isinstance(message, str):
        return record(reason="unparseable")
    try:
        time = datetime.fromisoformat(ts) if isinstance(ts, str) else None
    except ValueError:
        time = None
    if time is None:
        return record(reason="no_timestamp")
    attrs = {k: v for k, v in values.items() if k not in CONSUMED}
    dropped = []
    if "duration_ms" in values:
        duration = values["duration_ms"]
        if isinstance(duration, int | float) and not isinstance(duration, bool):
            attrs["duration_ms"] = duration
        else:
            dropped.append("duration_ms")
    status = values.get("status")
    code = status if isinstance(status, int) and not isinstance(status, bool) else int(status) if isinstance(status, str) and re.fullmatch("[0-9]+", status) else None
    if code is None and status is not None:
        dropped.append("status")
    if dropped:
        attrs["coercion_dropped"] = dropped
    text = lambda k: values.get(k) if isinstance(values.get(k), str) else None
    return record(micros=micros_of(time), naive=time.tzinfo is None, service=text("service"), level=text("level"), status=code if code is None or abs(code) < 1 << 31 else None, trace_id=text("trace_id"), message=message, attrs=json.dumps(attrs, ensure_ascii=False))


#: A key=value token of a line without backslashes: the value is bare or quoted whole.
_PAIR = re.compile(r"""[ \t\r\n]*([^ \t\r\n"'\\=]+)=(?:"([^"\\]*)"|'([^'\\]*)'|([^ \t\r\n"'\\]*))(?=[ \t\r\n]|\Z)""")


def _plain_pairs(line: str) -> dict[str, str] | None:
    """The pairs of a line of such tokens, as ``shlex`` splits them; None for other lines."""
    found, at = {}, 0
    while token := _PAIR.match(line, at):
        key, double, single, bare = token.groups()
        found[key] = double if double is not None else single if single is not None else bare
        at = token.end()
    return found if not line[at:].strip(" \t\r\n") else None


def parse_logfmt_line(line: str) -> dict[str, Any]:
    """Shell-quoted key=value tokens; the last of equal keys counts."""
    if (plain := _plain_pairs(line)) is not None:
        return _fields(plain)
    try:
        pairs = [t.split("=", 1) for t in shlex.split(line, posix=True)]
    except ValueError:
        return record(reason="unparseable")
    if any(len(p) < 2 or not p[0] for p in pairs):
        return record(reason="unparseable")
    return _fields({k: v for k, v in pairs})


def _udf(function: Callable[[str], dict[str, Any]]):
    @F.pandas_udf(PARSED)
    def parse(raw: pd.Series) -> pd.DataFrame:
        found = [function(x) for x in raw]
        frame = pd.DataFrame({name: pd.Series([f[name] for f in found], dtype=object) for name in record()})
        return frame.astype({"micros": "Int64", "status": "Int32", "naive": "boolean"})

    return parse


def parse_logfmt(lines: DataFrame) -> DataFrame:
    """Shell-quoted lines, in Arrow batches; a line without a service has the declared one."""
    parsed = lines.withColumn("p", _udf(parse_logfmt_line)(F.regexp_replace("raw", r"\r\z", "")))
    return parsed.withColumn("p", F.col("p").withField("service", F.coalesce("p.service", "declared")))


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """JSON objects, in built-in functions: a message and a time are needed, odd durations and statuses are named in coercion_dropped.

    Of equal keys the last counts. Attributes are what no column has, keys in order, then coercion_dropped.
    """
    rows = with_object(lines, F.regexp_replace("raw", r"\r\z", ""), "json_object")
    values, asked = F.col("json_object"), ("msg", "ts", "service", "level", "trace_id", "status", "duration_ms")
    # Plain columns, step by step: each value is taken out of the object once. (Fields of structs would be computed anew wherever they are used.)
    # A function of higher order keeps this step out of the method that makes the lines: fused, they are too long for the JVM to compile.
    rows = rows.withColumn("json_schemas", F.transform(F.array(*map(F.lit, asked)), lambda key: F.schema_of_variant(F.element_at(values, key))))
    rows = rows.withColumns({f"json_is_{k}": kind_of(F.get("json_schemas", F.lit(i))) for i, k in enumerate(asked)})
    texts = {f"json_{k}": F.when(F.col(f"json_is_{k}") == "string", field(values, k).try_cast("string")) for k in asked[:6]}
    rows = rows.withColumns(texts | {"json_code": F.when(F.col("json_is_status") == "integer", field(values, "status").try_cast("int"))})
    micros, naive = iso_time(F.col("json_ts"))
    is_kind = lambda key, *kinds: F.coalesce(F.col(f"json_is_{key}").isin(*kinds), F.lit(False))
    rows = rows.withColumns({"json_micros": micros, "json_naive": naive, "json_digits": F.coalesce(F.col("json_status").rlike("^[0-9]+$"), F.lit(False))})
    bad_duration = F.col("json_is_duration_ms").isNotNull() & ~is_kind("duration_ms", "integer", "number")
    bad_status = F.col("json_is_status").isNotNull() & ~is_kind("status", "integer", "null") & ~F.col("json_digits")
    reason = F.when(~is_kind("msg", "string"), "unparseable").when(F.col("json_micros").isNull(), "no_timestamp")
    rows = rows.withColumns({"json_dropped": F.array_compact(F.array(F.when(bad_duration, "duration_ms"), F.when(bad_status, "status"))), "json_reason": reason})
    dropped = F.col("json_dropped")
    no_names = F.array().cast("array<string>")
    hidden = F.concat(F.array(*map(F.lit, sorted(CONSUMED - {"duration_ms"}))), dropped, F.when(F.size(dropped) > 0, F.array(F.lit("coercion_dropped"))).otherwise(no_names))
    rows = rows.withColumn("json_hidden", hidden)  # a plain column, as each key asks it
    named = F.when(F.size(dropped) > 0, F.create_map(F.lit("coercion_dropped"), dropped.cast("variant"))).otherwise(F.create_map().cast("map<string,variant>"))
    attrs = F.to_json(F.map_concat(F.map_filter(values, lambda key, _: ~F.array_contains(F.col("json_hidden"), key)), named))
    code = F.coalesce("json_code", F.when(F.col("json_digits"), F.col("json_status").try_cast("int")))
    null = lambda t: F.lit(None).cast(t)
    parsed = {"reason": null("string"), "micros": F.col("json_micros"), "naive": F.col("json_naive"), "service": F.col("json_service"), "level": F.col("json_level"), "status": code, "trace_id": F.col("json_trace_id"), "message": F.col("json_msg"), "attrs": attrs}
    refused = F.struct(F.col("json_reason").alias("reason"), *(null(t).alias(n) for n, t in (f.split(":") for f in PARSED[7:-1].split(",")[1:])))
    rows = rows.withColumn("p", F.when(F.col("json_reason").isNull(), F.struct(*(c.alias(n) for n, c in parsed.items()))).otherwise(refused))
    return rows.select(*lines.columns, "p")


def parse_nginx(lines: DataFrame) -> DataFrame:
    """Access lines, in built-in functions; the level follows the status, the service is the declared one."""
    part = lambda i: F.regexp_extract("raw", NGINX, i)
    time = F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    given = lambda i: F.when(part(i) != "", part(i))
    duration = F.element_at(F.split(part(6), ","), -1).try_cast("double") * 1000
    upstream = F.when(F.col("raw").rlike(r' urt="[^"]*"\s*$'), part(7))
    message = F.concat_ws(" ", part(3), part(4))
    attrs = F.to_json(F.struct(duration.alias("duration_ms"), part(3).alias("method"), part(4).alias("path"), upstream.alias("upstream_times")))
    fits = F.col("raw").rlike(NGINX)
    reason = F.when(~fits, "unparseable").when(time.isNull(), "no_timestamp")
    return lines.withColumn(
        "p",
        F.struct(
            reason.alias("reason"), F.unix_micros(time).alias("micros"), F.lit(False).alias("naive"), F.col("declared").alias("service"), F.lit(None).cast("string").alias("level"),
            given(5).cast("int").alias("status"), F.lit(None).cast("string").alias("trace_id"), message.alias("message"), attrs.alias("attrs"),
        ),
    )


def _is_object(raw: Column) -> Column:
    return F.from_json(raw, "map<string,string>").isNotNull() & raw.rlike(r"^\s*\{")


FORMATS: tuple[LogFormat, ...] = (
    LogFormat("json-lines", _is_object, parse_json_lines),
    LogFormat("nginx", lambda raw: raw.rlike(NGINX), parse_nginx),
    LogFormat("logfmt", lambda raw: raw.contains("=") & ~raw.rlike(r"^\s*\{"), parse_logfmt),
    LogFormat("python-traceback", lambda raw: raw.rlike(HEADER), parse_tracebacks),
)


def detect(lines: DataFrame, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    return best_format(lines, {f.name: f.probe(F.col("raw")) for f in formats})


def format_mismatches(detected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose declared format is another than the detected one."""
    return detected.join(manifest.select("source_file", F.col("format").alias("declared_format")), "source_file").where("declared_format <> format")


def drafts(lines: DataFrame, services: DataFrame, manifest: DataFrame | None = None, formats: tuple[LogFormat, ...] = FORMATS) -> DataFrame:
    """Lines (source_file, source_offset, raw) -> log drafts: LOG_EVENTS without id, and reason.

    raw is text, or the line's bytes, whose ill-formed parts read as U+FFFD. ``manifest`` has (source_file, service, format); services have id, name and log_timezone. Both,
    and the detected formats, join on their keys: one row a file or service. Formats are detected
    once, into a table whose size the planner knows, and only formats that were found are parsed.
    """
    if dict(lines.dtypes)["raw"] == "binary":
        lines = lines.withColumnRenamed("raw", "raw_bytes").withColumn("raw", text_of(F.col("raw_bytes")))
    else:
        lines = lines.withColumn("raw_bytes", F.col("raw").cast("binary"))
    found = materialize(detect(lines, formats), "formats")
    present = {r[0] for r in found.select("format").distinct().collect()}  # of the few there are
    if manifest is not None:
        wrong = format_mismatches(found, manifest).limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"{r.source_file}: declared {r.declared_format}, looks like {r.format}" for r in wrong))
        declared = manifest.select("source_file", F.col("service").alias("declared"))
        known = lines.join(found, "source_file").join(declared, "source_file", "left")
    else:
        known = lines.join(found, "source_file").withColumn("declared", F.lit(None).cast("string"))
    parsed = None
    for f in [f for f in formats if f.name in present] or formats[:1]:
        own = known.where(F.col("format") == f.name).drop("format", *([] if f.raw_aware else ["raw_bytes"]))
        own = f.parse(own).select("source_file", "source_offset", "raw", "p")
        parsed = own if parsed is None else parsed.unionByName(own)
    return finished(parsed, services)


def finished(parsed: DataFrame, services: DataFrame) -> DataFrame:
    """Parsed records (source_file, source_offset, raw, p) -> drafts."""
    named = services.select(F.col("name").alias("service"), F.col("id").alias("service_id"), "log_timezone")
    rows = parsed.select("source_file", "source_offset", nfc(F.when(F.endswith("raw", F.lit("\r")), F.regexp_replace("raw", r"\r\z", "")).otherwise(F.col("raw"))).alias("raw"), "p.*").withColumn("service", component(F.col("service")))
    rows = rows.join(named, "service", "left")
    local = F.timestamp_micros("micros")
    instant, ambiguous, missing = attach_zone(local, F.coalesce("log_timezone", F.lit("UTC")))
    ts = F.when(F.col("naive") & F.col("service_id").isNotNull(), instant).otherwise(local)
    reason = F.coalesce("reason", F.when(F.col("service_id").isNull(), "no_service_match"))
    # The assembled format has never carried the two flags.
    flagged = lambda found: F.col("naive") & found & ~F.coalesce(F.get_json_object("attrs", "$.logger").isNotNull(), F.lit(False))
    flag = F.when(flagged(ambiguous), '"tz_ambiguous":true').when(flagged(missing), '"tz_nonexistent":true')
    attrs = F.when(flag.isNull(), F.col("attrs")).when(F.col("attrs") == "{}", F.concat(F.lit("{"), flag, F.lit("}"))).otherwise(F.concat(F.regexp_replace("attrs", r"\}\z", ","), flag, F.lit("}")))
    good = reason.isNull()
    keep = lambda c: F.when(good, c)
    return rows.select(
        log_uid(F.col("source_file"), F.col("source_offset"), F.col("raw")).alias("uid"),
        ts.alias("ts"),
        keep(F.col("service_id")).alias("service_id"),
        keep(canonical_level(F.col("level"), F.col("status"))).alias("level"),
        keep(F.col("status")).alias("status_code"),
        keep(F.col("trace_id")).alias("trace_id"),
        keep(F.col("message")).alias("message"),
        keep(template_hash(mask(F.coalesce("message", F.lit(""))))).alias("template_hash"),
        "raw",
        keep(attrs).alias("attrs"),
        "source_file",
        F.col("source_offset").cast("long").alias("source_offset"),
        reason.alias("reason"),
    )
