"""The parsers, mappings and the store over lines and payloads made of the driver's tables, each beside its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentry.functions import times
from evidentry.operators import provenance
from evidentry.operators.store import EvidenceStore, split_batch
from evidentry.plans import standins as S
from evidentry.plans.catalog import query
from evidentry.session import scratch_path
from evidentry.sources import formats, rawlines, records, terraform, webhooks
from evidentry.streaming.records import state_store, stream_tracebacks

CODE = "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 WHEN 'purchase' THEN 200 WHEN 'view' THEN 304 ELSE 404 END"
LEVEL = f"CASE WHEN event_id % 3 = 0 THEN 'warning' WHEN {CODE} = 500 THEN 'error' WHEN {CODE} = 404 THEN 'warning' ELSE 'info' END"


def _i():
    return F.col("event_id")


def _u():
    return F.col("user_id")


def _text(column):
    return column.cast("string")


def _services(spark):
    return S.services(spark).withColumn("log_timezone", F.lit("UTC"))


def _drafts(spark, lines, step, manifest=None):
    """Drafts of the lines, by event."""
    return formats.drafts(lines, _services(spark), manifest).withColumn("event_id", F.floor(F.col("source_offset") / step).cast("long")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _line(raw, file):
    return F.lit(f"logs/{file}.log").alias("source_file"), (_i() * 64).alias("source_offset"), raw.alias("raw")


def _reasoned(columns: str, time: str) -> str:
    """What structured lines give: every seventh is broken, the next has no time, the third no service."""
    return f"""WITH e AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 'unparseable' WHEN 1 THEN 'no_timestamp' WHEN 2 THEN 'no_service_match' END AS reason FROM events)
      SELECT event_id, reason, CASE WHEN event_id % 7 > 1 THEN {time} END AS ts, CASE WHEN reason IS NULL THEN (user_id % 10)::INT END AS service_id, CASE WHEN reason IS NULL THEN {LEVEL} END AS level,
      CASE WHEN reason IS NULL THEN {CODE}::INT END AS status_code, CASE WHEN reason IS NULL THEN event_type || ' by ' || user_id END AS message{columns} FROM e"""


_COLUMNS = ("event_id", "reason", "ts", "service_id", "level", "status_code", "message")


def _uid_sql(file: str, offset: str, raw: str) -> str:
    quoted = f"replace(replace(replace({raw}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
    return f"""substr(sha256('{{"file":"' || {file} || '","kind":"log","offset":' || ({offset}) || ',"raw":"' || {quoted} || '","v":1}}'), 1, 32)"""


#: A line's fields: when a field is there, and its text. {i}, {u}, {t}, {c} and {k} stand for the event's number, user, time, code and kind.
_FIELDS = (
    ("event_id % 7 <> 1", '"ts":"{t}"'), ("event_id % 4 = 0", '"level":"first"'), ("event_id % 3 = 0", '"level":"WARN"'), ("event_id % 7 = 2", '"service":"nobody"'), ("event_id % 7 <> 2", '"service":"svc-{u}"'), ("TRUE", '"msg":"{k} by user {i}"'),
    ("event_id % 2 = 0", '"trace_id":"t-{i}"'), ("event_id % 5 = 0", '"status":"{c}"'), ("event_id % 5 BETWEEN 1 AND 3", '"status":{c}'), ("event_id % 5 = 4", '"status":true'), ("event_id % 11 = 0", '"duration_ms":"fast"'), ("event_id % 11 > 3", '"duration_ms":{i}.5'),
    ("event_id % 13 = 0", '"zone":{{"b":[1,null],"a":"x"}}'), ("event_id % 13 = 1", '"host":"hé"'),
)


def _json_raw_sql() -> str:
    fill = lambda x: "replace(replace(replace(replace(replace('" + x.replace("{{", "{").replace("}}", "}") + "', '{i}', event_id::VARCHAR), '{u}', (user_id % 10)::VARCHAR), '{t}', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')), '{c}', (" + CODE + ")::VARCHAR), '{k}', event_type)"
    parts = ", ".join(f"CASE WHEN {when} THEN {fill(text)} END" for when, text in _FIELDS)
    return f"CASE WHEN event_id % 7 = 0 THEN '{{\"broken\":' ELSE '{{' || concat_ws(',', {parts}) || '}}' || CASE WHEN event_id % 17 = 0 THEN ' {{}}' ELSE '' END END"


_JSON_ATTRS = """'{' || concat_ws(',', CASE WHEN event_id % 11 > 3 THEN '"duration_ms":' || event_id || '.5' END, CASE WHEN event_id % 13 = 1 THEN '"host":"hé"' END, CASE WHEN event_id % 13 = 0 THEN '"zone":{"a":"x","b":[1,null]}' END,
    CASE WHEN event_id % 11 = 0 AND event_id % 5 = 4 THEN '"coercion_dropped":["duration_ms","status"]' WHEN event_id % 11 = 0 THEN '"coercion_dropped":["duration_ms"]' WHEN event_id % 5 = 4 THEN '"coercion_dropped":["status"]' END) || '}'"""


@query(f"""WITH e AS (SELECT *, {_json_raw_sql()} AS raw, CASE WHEN event_id % 7 = 0 OR event_id % 17 = 0 THEN 'unparseable' WHEN event_id % 7 = 1 THEN 'no_timestamp' WHEN event_id % 7 = 2 THEN 'no_service_match' END AS reason FROM events),
  f AS (SELECT *, CASE WHEN event_id % 5 < 4 THEN {CODE} END AS code FROM e)
  SELECT event_id, {_uid_sql("'logs/json.log'", "event_id * 512", "raw")} AS uid, reason, CASE WHEN reason IS NULL OR reason = 'no_service_match' THEN ts END AS ts, CASE WHEN reason IS NULL THEN (user_id % 10)::INT END AS service_id,
  CASE WHEN reason IS NULL THEN CASE WHEN event_id % 3 = 0 THEN 'warning' WHEN event_id % 4 = 0 THEN 'info' WHEN code BETWEEN 500 AND 599 THEN 'error' WHEN code BETWEEN 400 AND 499 THEN 'warning' ELSE 'info' END END AS level, CASE WHEN reason IS NULL THEN code::INT END AS status_code,
  CASE WHEN reason IS NULL AND event_id % 2 = 0 THEN 't-' || event_id END AS trace_id, CASE WHEN reason IS NULL THEN event_type || ' by user ' || event_id END AS message,
  CASE WHEN reason IS NULL THEN substr(sha256(event_type || ' by user <NUM>'), 1, 32) END AS template_hash, CASE WHEN reason IS NULL THEN {_JSON_ATTRS} END AS attrs FROM f""")
def json_lines(spark, d):
    """JSON lines with repeated keys, odd types, text after the object, nested and escaped values, through to identities."""
    e = S.read(spark, d, "events").withColumn("code", F.expr(CODE))

    values = {"{i}": _text(_i()), "{u}": _text(_u() % 10), "{t}": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "{c}": _text(F.col("code")), "{k}": F.col("event_type")}
    known = F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isNotNull()

    def filled(text):
        parts = re.split(r"(\{[iutck]\})", text.replace("{{", "\0").replace("}}", "\1"))
        return F.concat(*(values.get(p, F.lit(p.replace("\0", "{").replace("\1", "}"))) for p in parts if p))

    fields = F.when(known, F.concat_ws(",", *(F.when(F.expr(when), filled(text)) for when, text in _FIELDS))).otherwise("")  # a missing value leaves none
    whole = F.concat(F.lit("{"), fields, F.lit("}"), F.when(_i() % 17 == 0, " {}").otherwise(""))
    raw = F.when(_i() % 7 == 0, '{"broken":').otherwise(whole)
    lines = e.select(F.lit("logs/json.log").alias("source_file"), (_i() * 512).alias("source_offset"), raw.alias("raw"))
    return _drafts(spark, lines, 512).select(*_COLUMNS, "uid", "trace_id", "template_hash", "attrs")


@query(_reasoned("", "ts"))
def logfmt_lines(spark, d):
    e = S.read(spark, d, "events")
    time = F.when(_i() % 7 == 1, F.lit("")).otherwise(F.concat(F.lit("ts="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" ")))
    level = F.when(_i() % 3 == 0, "level=warn ").otherwise("")
    service = F.when(_i() % 7 == 2, "nobody").otherwise(F.concat(F.lit("svc-"), _text(_u() % 10)))
    raw = F.concat(time, level, F.lit("service="), service, F.lit(' msg="'), F.col("event_type"), F.lit(" by "), _text(_u()), F.when(_i() % 7 == 0, "").otherwise('"'), F.lit(" status="), _text(F.expr(CODE)), F.lit(" user='a b'"))
    return _drafts(spark, e.select(*_line(raw, "fmt")), 64).select(*_COLUMNS)


@query(f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unparseable' END AS reason, CASE WHEN event_id % 7 > 0 THEN date_trunc('second', ts)::TIMESTAMP END AS ts, CASE WHEN event_id % 7 > 0 THEN 4 END AS service_id,
  CASE WHEN event_id % 7 > 0 THEN CASE WHEN {CODE} = 500 THEN 'error' WHEN {CODE} = 404 THEN 'warning' ELSE 'info' END END AS level, CASE WHEN event_id % 7 > 0 THEN {CODE}::INT END AS status_code,
  CASE WHEN event_id % 7 > 0 THEN 'GET /u/' || user_id END AS message, CASE WHEN event_id % 7 > 0 THEN (event_id % 8) * 125.0::DOUBLE END AS duration_ms FROM events""")
def nginx_lines(spark, d):
    e = S.read(spark, d, "events")
    raw = F.concat(
        F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'"), F.lit('] "GET /u/'), _text(_u()), F.lit(' HTTP/1.1" '), _text(F.expr(CODE)), F.lit(' 17 "-" "agent" rt='), _text((_i() % 8) * 0.125),
    )
    lines = e.select(*_line(F.when(_i() % 7 == 0, "no access line").otherwise(raw), "access"))
    manifest = spark.createDataFrame([("logs/access.log", "svc-4", "nginx")], "source_file string, service string, format string")
    return _drafts(spark, lines, 64, manifest).select(*_COLUMNS, F.get_json_object("attrs", "$.duration_ms").cast("double").alias("duration_ms"))


@query("""SELECT event_id, NULL::VARCHAR AS reason, date_trunc('millisecond', ts)::TIMESTAMP AS ts, (user_id % 10)::INT AS service_id, 'error' AS level, NULL::INT AS status_code,
  CASE WHEN event_id % 3 = 0 THEN 'KeyError: k' || event_id WHEN event_id % 3 = 1 THEN 'ValueError: bad ' || event_id ELSE 'plain ' || event_id END AS message, CASE event_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 4 END AS top_line, CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 1 END AS lines FROM events""")
def traceback_records(spark, d):
    """Records of one to eight lines: a header, a traceback for two of three, and for one of them a second one that it led to."""
    t = _text(_i())
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" ERROR [svc-"), _text(_u() % 10), F.lit("] app.x: plain "), t)
    first = [F.lit(records.START), F.lit('  File "/srv/app.py", line 4, in run'), F.concat(F.lit("ValueError: bad "), t)]
    second = [F.lit("During handling of the above exception, another exception occurred:"), F.lit(records.START), F.lit('  File "/srv/app.py", line 9, in retry'), F.concat(F.lit("KeyError: k"), t)]
    raws = F.when(_i() % 3 == 0, F.array(head, *first, *second)).when(_i() % 3 == 1, F.array(head, *first)).otherwise(F.array(head))
    lines = S.read(spark, d, "events").select("event_id", F.posexplode(raws).alias("k", "raw")).select(F.lit("logs/py.log").alias("source_file"), (_i() * 512 + F.col("k") * 64).alias("source_offset"), "raw")
    found = _drafts(spark, lines, 512)
    return found.select(*_COLUMNS, F.get_json_object("attrs", "$.top_frame.line").cast("int").alias("top_line"), F.size(F.split("raw", "\n")).alias("lines"))


#: A record's lines by its kind: a header alone, an exception, a traceback that is cut off, one that led to another; the fifth is a line without a header.
_RECORD_LINES = (
    ("{h}",),
    ("{h}", records.START, '  File "/srv/app.py", line 4, in run', "ValueError: bad {i}"),
    ("{h}", records.START, '  File "/srv/app.py", line 7, in run'),
    ("{h}", records.START, '  File "/srv/app.py", line 4, in run', "ValueError: bad {i}", "During handling of the above exception, another exception occurred:", records.START, '  File "/lib/dep.py", line 9', "KeyError: key {i}"),
    ("stray {i}",),
)


def _record_lines(spark, d):
    e = S.read(spark, d, "events")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" ERROR [svc-"), _text(_u() % 10), F.lit("] app.x: plain "), _text(_i()))
    e = e.withColumn("head", F.when(_i().isNotNull(), head))
    filled = lambda text: F.col("head") if text == "{h}" else F.when(F.col("head").isNotNull(), F.concat(F.lit(text[:-3]), _text(_i()))) if text.endswith("{i}") else F.when(F.col("head").isNotNull(), F.lit(text))
    raws = F.lit(None).cast("array<string>")
    for k, lines in enumerate(_RECORD_LINES):  # only the lines of the event's own kind are made
        raws = F.when(_i() % 5 == k, F.array(*map(filled, lines))).otherwise(raws)
    rows = e.select("event_id", F.concat(F.lit("logs/py-"), _text(_u() % 20), F.lit(".log")).alias("source_file"), F.posexplode(raws).alias("k", "raw"))
    return rows.select("source_file", (_i() * 512 + F.col("k") * 64).alias("source_offset"), "raw")


def _record_drafts(found):
    named = found.withColumn("event_id", F.floor(F.col("source_offset") / 512).cast("long")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    part = lambda path: F.get_json_object("attrs", path)
    return named.select(
        "event_id", "uid", "reason", "ts", "service_id", "level", "message", "template_hash", F.size(F.split("raw", "\n")).alias("lines"),
        part("$.assembly").alias("assembly"), part("$.exc_type").alias("exc_type"), part("$.top_frame.line").cast("int").alias("top_line"), F.size(F.from_json(part("$.stack"), "array<string>")).alias("frames"),
    )


_RECORDS_SQL = f"""WITH e AS (SELECT *, event_id % 5 AS kind, 'logs/py-' || (user_id % 20) || '.log' AS file, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ERROR [svc-' || (user_id % 10) || '] app.x: plain ' || event_id AS head FROM events),
  t AS (SELECT *, CASE kind {" ".join(f"WHEN {k} THEN " + "'" + chr(10).join(x).replace("'", "''").replace("{h}", "' || head || '").replace("{i}", "' || event_id || '") + "'" for k, x in enumerate(_RECORD_LINES))} END AS raw,
    sum((kind <> 4)::INT) OVER (PARTITION BY file ORDER BY event_id) AS rec FROM e),
  r AS (SELECT file, min(event_id) AS event_id, first(kind ORDER BY event_id) AS kind, first(ts ORDER BY event_id) AS ts, first(user_id ORDER BY event_id) AS user_id, string_agg(raw, chr(10) ORDER BY event_id) AS raw,
    coalesce(string_agg(chr(10) || raw, '' ORDER BY event_id) FILTER (WHERE kind = 4), '') AS strays, rec = max(max(rec)) OVER (PARTITION BY file) AS is_last FROM t WHERE rec > 0 GROUP BY file, rec
    UNION ALL SELECT file, event_id, 4, ts, user_id, raw, '', FALSE FROM t WHERE rec = 0),
  m AS (SELECT *, CASE WHEN kind = 4 THEN 'unparseable' WHEN kind = 2 AND is_last THEN 'incomplete_traceback' END AS reason,
    CASE kind WHEN 1 THEN 'ValueError: bad ' || event_id || strays WHEN 3 THEN 'KeyError: key ' || event_id || strays ELSE 'plain ' || event_id END AS message FROM r)
  SELECT event_id, {_uid_sql("file", "event_id * 512", "raw")} AS uid, reason, CASE WHEN reason IS NULL THEN date_trunc('millisecond', ts)::TIMESTAMP END AS ts, CASE WHEN reason IS NULL THEN (user_id % 10)::INT END AS service_id, CASE WHEN reason IS NULL THEN 'error' END AS level,
    CASE WHEN reason IS NULL THEN message END AS message, CASE WHEN reason IS NULL THEN substr(sha256(replace(regexp_replace(message, '[0-9]+', '<NUM>', 'g'), chr(10), ' ')), 1, 32) END AS template_hash, len(string_split(raw, chr(10)))::INT AS lines,
    CASE WHEN reason IS NULL AND kind = 2 THEN 'incomplete' END AS assembly, CASE WHEN reason IS NULL THEN CASE kind WHEN 1 THEN 'ValueError' WHEN 3 THEN 'KeyError' END END AS exc_type,
    CASE WHEN reason IS NULL THEN CASE kind WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 9 END END AS top_line, CASE WHEN reason IS NULL THEN CASE kind WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END END AS frames FROM m"""


@query(_RECORDS_SQL)
def traceback_files(spark, d):
    """Records of twenty files, by ordered scans: stray lines, tracebacks that a header or the file's end cuts off, chained ones, through to identities."""
    return _record_drafts(formats.drafts(_record_lines(spark, d), _services(spark)))


@query(_RECORDS_SQL)
def streamed_tracebacks(spark, d):
    """The same lines landing in three pieces, cut inside records, through a stream with keyed state."""
    lines = _record_lines(spark, d).withColumn("declared", F.lit(None).cast("string"))
    landing, out, marks = (scratch_path(spark, f"lines-{x}") for x in ("in", "out", "marks"))
    top = lines.agg(F.coalesce(F.max("source_offset"), F.lit(0))).first()[0]
    edges = [-1, top // 3 // 512 * 512 + 32, 2 * top // 3 // 512 * 512 + 96, 1 << 62]
    ends = lines.select("source_file", F.lit(1 << 61).alias("source_offset"), F.lit(None).cast("string").alias("raw"), "declared").distinct()
    with state_store(spark):
        for low, high in zip(edges, edges[1:]):
            piece = lines.unionByName(ends).where((F.col("source_offset") > low) & (F.col("source_offset") <= high))
            piece.write.mode("append").parquet(landing)
            stream = stream_tracebacks(spark.readStream.schema(lines.schema).parquet(landing))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return _record_drafts(formats.finished(spark.read.parquet(out), _services(spark)))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT doc_id, (i - 1)::INT AS ordinal, sha256(line) AS line_sha256, octet_length(encode(line))::INT AS bytes, TRUE AS adjoins FROM l""")
def raw_file_lines(spark, d):
    """Lines written to files and read as bytes, in splits of 64 KB; adjoins says that a line begins where the one before it ends."""
    folder = scratch_path(spark, "text-files")
    numbered = S.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    numbered.select(F.concat(_text(F.col("doc_id")), F.lit(":"), _text(F.col("ordinal")), F.lit(":"), "line")).write.text(folder)
    found = rawlines.read_lines(spark, folder, split_bytes=1 << 16).withColumn("text", rawlines.text_of(F.col("raw")))
    before = F.lag(F.col("source_offset") + F.col("length") + 1, 1, 0).over(W.partitionBy("source_file").orderBy("source_offset"))
    part = lambda i: F.regexp_extract("text", r"(?s)^(\d+):(\d+):(.*)$", i)
    read = found.select("source_file", "source_offset", F.octet_length("raw").alias("length"), part(1).cast("long").alias("doc_id"), part(2).cast("int").alias("ordinal"), F.sha2(part(3).cast("binary"), 256).alias("line_sha256"), F.octet_length(part(3)).alias("bytes"))
    return read.select("doc_id", "ordinal", "line_sha256", "bytes", (before == F.col("source_offset")).alias("adjoins"))


@query("""SELECT sha1(event_id::VARCHAR) AS sha, CASE WHEN event_id % 7 <> 1 THEN 'org/repo-' || (user_id % 10) END AS repo, CASE event_id % 7 WHEN 0 THEN 'truncated' WHEN 1 THEN 'repository' WHEN 2 THEN 'paths' END AS error,
  date_trunc('second', ts)::TIMESTAMP AS committed_at, CASE WHEN event_id % 7 = 2 THEN 3 ELSE 2 END AS files FROM events""")
def push_mapping(spark, d):
    e = S.read(spark, d, "events")
    sha, path = F.sha1(_text(_i())), F.concat(F.lit("src/"), _text(_i()))
    commit = F.struct(
        sha.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("message"), F.struct(F.lit("a").alias("name")).alias("author"),
        F.array(path).alias("added"), F.when(_i() % 7 == 2, F.array(path, F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("modified"), F.array().cast("array<string>").alias("removed"),
    )
    name = F.when(_i() % 7 == 1, "no name").otherwise(F.concat(F.lit("Org/Repo-"), _text(_u() % 10), F.lit(".git")))
    push = F.struct(F.struct(name.alias("full_name")).alias("repository"), F.struct(F.when(_i() % 7 == 0, "other").otherwise(sha).alias("id")).alias("head_commit"), F.array(commit).alias("commits"))
    found = webhooks.push_exports(e.select(F.to_json(push).alias("value")))
    c = F.col("commits")[0]
    return found.select(c["sha"].alias("sha"), "repo", "error", c["committed_at"].cast("timestamp_ntz").alias("committed_at"), F.size(c["files_changed"]).alias("files"))


@query("""WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'replace' END AS action FROM customer)
  SELECT 'node.n' || k AS resource_name, action, CASE WHEN k % 20 < 10 THEN (k % 20)::INT END AS service_id,
    CASE WHEN k % 3 = 0 THEN '{"secret": {"after": "<redacted>", "before": "<redacted>"}}' ELSE '{"secret": {"after": "<redacted>", "before": "<redacted>"}, "size": {"after": ' || (k + k % 3) || ', "before": ' || k || '}}' END AS attribute_diff
  FROM c WHERE action IS NOT NULL AND k % 2 = 0""")
def infra_plan_rows(spark, d):
    """Planned resources of every customer; the plans of odd ones failed to apply."""
    k = F.col("c_custkey")
    actions = F.when(k % 5 == 0, F.array(F.lit("create"))).when(k % 5 == 1, F.array(F.lit("update"))).when(k % 5 == 2, F.array(F.lit("delete"))).when(k % 5 == 3, F.array(F.lit("delete"), F.lit("create"))).otherwise(F.array(F.lit("no-op")))
    side = lambda size: F.struct(size.alias("size"), F.lit("hush").alias("secret"), F.struct(_text(k % 20).alias("app")).alias("tags"))
    change = F.struct(actions.alias("actions"), side(k).alias("before"), side(k + k % 3).alias("after"), F.struct(F.lit(True).alias("secret")).alias("before_sensitive"), F.struct(F.lit(True).alias("id")).alias("after_unknown"))
    resource = F.struct(F.concat(F.lit("node.n"), _text(k)).alias("address"), F.lit("node").alias("type"), change.alias("change"))
    plans = S.read(spark, d, "customer").select(F.concat(F.lit("plan-"), _text(k % 2)).alias("plan_file"), F.to_json(resource).alias("resource"))
    applies = spark.createDataFrame([("a0", "plan-0", "success"), ("a1", "plan-1", "failed")], "apply_id string, plan_file string, status string").withColumn("applied_at", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    services = S.services(spark).withColumn("infra_tags", F.create_map(F.lit("app"), _text(F.col("id"))))
    return terraform.infra_changes(plans, applies, services).select("resource_name", "action", "service_id", "attribute_diff")


def _two_batches(spark, d):
    """A store after two batches: two thirds of the events, some of them unresolved; then all of them, resolved."""
    drafts = S.log_events(spark, d).drop("id").withColumn("reason", F.lit(None).cast("string"))
    at = F.col("source_offset") / 64
    none = {c: F.lit(None) for c in ("service_id", "level", "status_code", "trace_id", "message", "template_hash", "attrs")}
    first = drafts.where(at % 3 != 0)
    broken = first.where(at % 5 == 0).withColumns({c: v.cast(dict(first.dtypes)[c]) for c, v in none.items()}).withColumn("reason", F.lit("no_timestamp"))
    store = EvidenceStore(spark, scratch_path(spark, "evidence"))
    return store, [store.ingest(first.where(at % 5 != 0).unionByName(broken)), store.ingest(drafts)]


@query("""SELECT 1 AS batch, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 5 > 0) AS inserted, 0 AS duplicates, 0 AS promoted, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 5 = 0) AS unresolved FROM events
  UNION ALL SELECT 2, count(*) FILTER (WHERE event_id % 3 = 0), count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 5 > 0), count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 5 = 0), 0 FROM events""")
def store_ingest(spark, d):
    _, reports = _two_batches(spark, d)
    return spark.createDataFrame([(i + 1, r.inserted, r.duplicates, r.promoted, r.unresolved) for i, r in enumerate(reports)], "batch int, inserted long, duplicates long, promoted long, unresolved long")


@query(f"WITH {S.LOG_SQL} SELECT service_id, bucket_start, status_class, level, template_hash, count, first_seen, last_seen FROM rollups")
def store_rollups(spark, d):
    """The rollups that the store keeps after both batches, against those of all events at once."""
    store, _ = _two_batches(spark, d)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("bucket_start", "first_seen", "last_seen")}
    return store.read("rollups").withColumns(times).select("service_id", "bucket_start", "status_class", "level", "template_hash", "count", "first_seen", "last_seen")


@query("""WITH o AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'conflict' WHEN event_id % 10 = 1 THEN 'regression' WHEN event_id % 3 = 0 THEN 'inserted' ELSE 'duplicate' END AS outcome FROM events)
  SELECT event_id, outcome, CASE WHEN event_id % 10 = 0 AND event_id % 3 > 0 THEN 'message,level' ELSE '' END AS differs FROM o WHERE NOT (event_id % 10 = 0 AND event_id % 3 = 0) AND NOT (event_id % 10 = 1 AND event_id % 3 = 0)
  UNION ALL SELECT event_id, 'inserted', '' FROM events WHERE event_id % 10 IN (0, 1) AND event_id % 3 = 0""")
def batch_outcomes(spark, d):
    """Each line of a second batch against the first: new, equal, with other content (and which), or unresolved now though it was resolved."""
    drafts = S.log_events(spark, d).drop("id").withColumn("event_id", (F.col("source_offset") / 64).cast("long"))
    stored = drafts.where(_i() % 3 > 0)
    changed = _i() % 10 == 0
    batch = drafts.withColumn("message", F.when(changed, F.concat("message", F.lit("!"))).otherwise(F.col("message"))).withColumn("level", F.when(changed, "fatal").otherwise(F.col("level")))
    lost = batch.where(_i() % 10 == 1)
    back = lost.join(stored.select("uid"), "uid", "left_semi").select("event_id", F.lit("regression").alias("outcome"), F.lit("").alias("differs"))
    new = lost.join(stored.select("uid"), "uid", "left_anti").select("event_id", F.lit("inserted").alias("outcome"), F.lit("").alias("differs"))
    found = split_batch(batch.where(_i() % 10 != 1), stored, "uid", ["message", "level", "service_id", "ts"])
    return found.select("event_id", "outcome", F.array_join("differs", ",").alias("differs")).union(back).union(new)


_ZONES = ("America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "UTC", "America/Sao_Paulo")


@query(f"""WITH l AS (SELECT event_id, ts::TIMESTAMP + INTERVAL 1 DAY * (event_id % 366) AS local, [{", ".join(f"'{z}'" for z in _ZONES)}][event_id % {len(_ZONES)} + 1] AS zone FROM events),
  w AS (SELECT *, (local AT TIME ZONE zone) AT TIME ZONE 'UTC' AS late FROM l),
  x AS (SELECT *, ((late AT TIME ZONE 'UTC') AT TIME ZONE zone) <> local AS missing, (((late - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE zone) = local AS doubled FROM w)
  SELECT event_id, zone, CASE WHEN doubled THEN late - INTERVAL 1 HOUR ELSE late END AS instant, doubled AS tz_ambiguous, missing AS tz_nonexistent FROM x""")
def zone_attach(spark, d):
    """Wall clocks over a year in six zones as instants, with both flags."""
    e = S.read(spark, d, "events")
    local = F.col("ts").cast("timestamp") + F.make_dt_interval(days=(_i() % 366).cast("int"))
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (_i() % len(_ZONES) + 1).cast("int"))
    instant, ambiguous, missing = times.attach_zone(F.col("local"), F.col("zone"))
    rows = e.select("event_id", local.alias("local"), zone.alias("zone"))
    return rows.select("event_id", "zone", instant.cast("timestamp_ntz").alias("instant"), ambiguous.alias("tz_ambiguous"), missing.alias("tz_nonexistent"))


@query("""WITH t AS (SELECT conv_id, turn, 'log:' || md5(role || (length(text) % 50)) AS a, 'commit:' || sha1(role || (length(text) % 40)) AS b FROM conversations),
  c AS (SELECT conv_id, turn, a AS cite FROM t WHERE turn % 3 <> 1 UNION ALL SELECT conv_id, turn, b FROM t WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, a FROM t WHERE turn % 2 = 0)
  SELECT cite, min(conv_id * 1000 + turn)::BIGINT AS first_event, count(*)::BIGINT AS n FROM (SELECT DISTINCT conv_id, turn, cite FROM c) GROUP BY cite""")
def capture_index(spark, d):
    """Where each citation of a trace was captured first, from single and listed citations of its results."""
    c = S.read(spark, d, "conversations")
    a, b = F.concat(F.lit("log:"), F.md5(F.concat("role", _text(F.length("text") % 50)))), F.concat(F.lit("commit:"), F.sha1(F.concat("role", _text(F.length("text") % 40))))
    turn = F.col("turn")
    results = c.select((F.col("conv_id") * 1000 + turn).alias("event"), F.when(turn % 3 != 1, a).alias("cite"), F.when(turn % 2 == 0, F.array(b, a)).alias("source_cites"))
    trace = provenance.captured_cites(results, "cite", "source_cites", by="event").groupBy("event").agg(F.collect_list("cite").alias("cites"))
    counts = trace.select(F.explode("cites").alias("cite")).groupBy("cite").agg(F.count("*").alias("n"))
    return provenance.first_captures(trace).join(counts, "cite").select("cite", F.col("event").alias("first_event"), "n")

