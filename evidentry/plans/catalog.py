"""The library's operators over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentry.functions import citations, texts, times, vectors
from evidentry.functions.identity import infra_uid
from evidentry.operators import changes, provenance, resolve, rollups, similar, telemetry
from evidentry.operators.integrity import doubled, transitions, violations
from evidentry.operators.store import latest_snapshot, split_batch
from evidentry.plans import standins as S

WINDOW = times.resolve_window(datetime(2024, 1, 16, 0, 0, 20), datetime(2024, 1, 18, 0, 0, 5))
CHANGE_WINDOW = times.resolve_window(datetime(1998, 3, 1), datetime(1998, 3, 15))
SERVICE, SERVICE_ID = "svc-3", 3
IN = "bucket_start >= TIMESTAMP '2024-01-16 00:00:00' AND bucket_start < TIMESTAMP '2024-01-18 00:01:00'"
BEFORE = "bucket_start >= TIMESTAMP '2024-01-13 23:59:00' AND bucket_start < TIMESTAMP '2024-01-16 00:00:00'"
CHANGED = ">= TIMESTAMP '1998-02-28 23:00:00'", "< TIMESTAMP '1998-03-15 00:00:00'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _rollups(spark, d):
    return rollups.rollup(S.log_events(spark, d), bucket=times.minute_ntz("ts"))


def _window_events(spark, d):
    """Events of both windows. Windows are whole minutes, so the bound on the raw time says the same as one on minutes, and reaches the scan."""
    return S.log_events(spark, d).where(times.Window(WINDOW.before().start, WINDOW.end).holds(F.col("ts")))


def _window_rows(spark, d):
    return telemetry.rollups_in(rollups.rollup(_window_events(spark, d), bucket=times.minute_ntz("ts")), S.services(spark), SERVICE, WINDOW)


def _with_exemplars(spark, d):
    return telemetry.with_exemplars(_window_rows(spark, d), _window_events(spark, d))


@query(f"WITH {S.LOG_SQL} SELECT service_id, bucket_start, status_class, level, template_hash, count, first_seen, last_seen, exemplar_id FROM rollups")
def minute_rollup(spark, d):
    return _rollups(spark, d)


@query(f"WITH {S.LOG_SQL} SELECT id, rich FROM log_events")
def richness(spark, d):
    return S.log_events(spark, d).select("id", rollups.richness(F.col("trace_id"), F.col("attrs")).alias("rich"))


@query(f"WITH {S.LOG_SQL} SELECT status_class, sum(count)::BIGINT AS count, string_agg(cite, ',' ORDER BY cite) AS source_cites FROM rollups WHERE service = 'svc-3' AND {IN} GROUP BY 1")
def status_breakdown(spark, d):
    return telemetry.status_breakdown(_window_rows(spark, d)).withColumn("source_cites", F.array_join("source_cites", ","))


@query(f"WITH {S.LOG_SQL} SELECT bucket_start, status_class, sum(count)::BIGINT AS count, string_agg(cite, ',' ORDER BY cite) AS source_cites FROM rollups WHERE service = 'svc-3' AND {IN} GROUP BY 1, 2")
def series_by_status(spark, d):
    return telemetry.series(_window_rows(spark, d)).withColumn("source_cites", F.array_join("source_cites", ","))


_ANOMALIES = f"""WITH {S.LOG_SQL},
  seen AS (SELECT r.*, {IN} AS now, e.uid, e.rich FROM rollups r JOIN log_events e ON r.exemplar_id = e.id WHERE r.service = 'svc-3' AND (({IN.replace("bucket_start", "r.bucket_start")}) OR ({BEFORE.replace("bucket_start", "r.bucket_start")}))),
  found AS (SELECT status_class, level, template_hash, coalesce(sum(count) FILTER (WHERE now), 0)::BIGINT AS count, coalesce(sum(count) FILTER (WHERE NOT now), 0)::BIGINT AS baseline_count,
    coalesce(string_agg(cite, ',' ORDER BY cite) FILTER (WHERE now), '') AS source_cites, coalesce(string_agg(cite, ',' ORDER BY cite) FILTER (WHERE NOT now), '') AS baseline_cites,
    'log:' || arg_min(uid, row(NOT now, -rich, uid)) AS exemplar_cite FROM seen GROUP BY 1, 2, 3)"""
_ANOMALIES = _ANOMALIES.replace(f"r.*, {IN} AS now", f"r.*, {IN.replace('bucket_start', 'r.bucket_start')} AS now")


def _anomalies(spark, d):
    found = telemetry.anomalies(_with_exemplars(spark, d))
    return found.select("status_class", "level", "template_hash", "count", "baseline_count", "delta", F.array_join("source_cites", ",").alias("source_cites"), F.array_join("baseline_cites", ",").alias("baseline_cites"), F.col("exemplar.cite").alias("exemplar_cite"))


@query(f"{_ANOMALIES} SELECT *, count - baseline_count AS delta FROM found")
def telemetry_anomalies(spark, d):
    return _anomalies(spark, d)


@query(f"""{_ANOMALIES}, ranked AS (SELECT status_class, level, template_hash, count, count - baseline_count AS delta, (status_class = '5xx' OR level IN ('error', 'fatal')) AS is_error FROM found)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_error ORDER BY delta DESC, count DESC, template_hash, status_class, level)::INT AS rank FROM ranked) WHERE rank <= 2""")
def two_pool_topn(spark, d):
    return telemetry.top_templates(_anomalies(spark, d), 2).select("status_class", "level", "template_hash", "count", "delta", "is_error", "rank")


@query(f"WITH {S.LOG_SQL} SELECT coalesce(sum(count), 0) < 50 AS baseline_sparse FROM rollups WHERE service = 'svc-3' AND {BEFORE}")
def baseline_sparse(spark, d):
    return telemetry.baseline_sparse(_window_rows(spark, d), 50)


@query(f"WITH {S.LOG_SQL} SELECT trace_id, min(row(e.ts, e.uid)).ts AS ts, min(row(e.ts, e.uid)).uid AS uid FROM rollups r JOIN log_events e ON r.exemplar_id = e.id WHERE r.service = 'svc-3' AND {IN.replace('bucket_start', 'r.bucket_start')} AND e.trace_id <> '' GROUP BY 1 ORDER BY 2, 3 LIMIT 5".replace("min(row(e.ts, e.uid)).ts", "min({'ts': e.ts, 'uid': e.uid}).ts").replace("min(row(e.ts, e.uid)).uid", "min({'ts': e.ts, 'uid': e.uid}).uid"))
def sample_traces(spark, d):
    return telemetry.sample_traces(_with_exemplars(spark, d))


@query(f"WITH {S.LOG_SQL} SELECT template_hash, level, sum(CASE WHEN counts THEN k END)::BIGINT AS occurrence_count FROM log_events WHERE service_id = 3 AND ts >= TIMESTAMP '2024-01-16 00:00:00' AND ts < TIMESTAMP '2024-01-18 00:01:00' GROUP BY 1, 2")
def occurrence_count(spark, d):
    return telemetry.occurrence_counts(S.log_events(spark, d), SERVICE_ID, WINDOW)


@query(f"""WITH {S.LOG_SQL}, dirty AS (SELECT DISTINCT service_id, bucket_start FROM stood WHERE id % 50 = 7)
  SELECT r.service_id, r.bucket_start, r.status_class, r.level, r.template_hash, r.count, r.first_seen, r.last_seen, r.exemplar_id FROM rollups r""")
def dirty_recompute(spark, d):
    """Late events dirty their minutes: the rollups of the others plus a recompute equal a full rebuild."""
    events = S.log_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.where("id % 50 = 7")
    stale = rollups.rollup(events.where("id % 50 <> 7"))
    out = rollups.recompute(events, stale, rollups.dirty_minutes(late, stale))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("bucket_start", "first_seen", "last_seen")})


@query(f"WITH {S.LOG_SQL} SELECT DISTINCT service_id, bucket_start FROM stood WHERE id % 50 = 7")
def dirty_minutes(spark, d):
    events = S.log_events(spark, d)
    found = rollups.dirty_minutes(events.where("id % 50 = 7"), rollups.rollup(events))
    return found.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query(f"""WITH {S.CHANGE_SQL},
  d AS (SELECT * FROM deployments WHERE started_at {CHANGED[0]} AND started_at {CHANGED[1]}),
  stream AS (SELECT d.service_id, 'deployment' AS kind, d.started_at AS "at", 'deploy:' || d.uid AS cite FROM d JOIN commits c ON d.commit_sha = c.sha
    UNION ALL SELECT c.service_id, 'commit', committed_at, 'commit:' || sha FROM commits c WHERE committed_at {CHANGED[0]} AND committed_at {CHANGED[1]} AND NOT EXISTS (SELECT 1 FROM d WHERE d.service_id = c.service_id AND d.commit_sha = c.sha)
    UNION ALL SELECT service_id, 'infra', applied_at, 'infra:' || uid FROM infra WHERE applied_at {CHANGED[0]} AND applied_at {CHANGED[1]})
  SELECT service_id, kind, "at", cite FROM stream""")
def incident_changes(spark, d):
    return changes.change_stream(S.commits(spark, d), S.deployments(spark, d), S.infra_changes(spark, d), CHANGE_WINDOW.widened(60))


@query(f"""{ORACLES["incident_changes"].rsplit("SELECT service_id, kind", 1)[0]}
  SELECT service_id, 'svc-' || service_id AS service, count(*) FILTER (WHERE kind = 'commit') AS commits, count(*) FILTER (WHERE kind = 'deployment') AS deployments,
    count(*) FILTER (WHERE kind = 'infra') AS infra_changes, string_agg(cite, ',' ORDER BY "at" DESC, cite) AS cites FROM stream WHERE service_id IS NOT NULL AND service_id <> 3 GROUP BY 1, 2""")
def peer_service_changes(spark, d):
    stream = changes.change_stream(S.commits(spark, d), S.deployments(spark, d), S.infra_changes(spark, d), CHANGE_WINDOW.widened(60))
    return changes.by_service(stream.where(F.col("service_id") != SERVICE_ID), S.services(spark)).withColumn("cites", F.array_join("cites", ","))


@query(f"WITH {S.CHANGE_SQL} SELECT uid, applied_at, resource_name FROM infra WHERE service_id IS NULL AND applied_at {CHANGED[0]} AND applied_at {CHANGED[1]}")
def unattributed_changes(spark, d):
    return changes.unattributed(S.infra_changes(spark, d), CHANGE_WINDOW.widened(60)).select("uid", "applied_at", "resource_name")


@query(f"WITH {S.CHANGE_SQL} SELECT sha, service_id, committed_at FROM commits c WHERE committed_at {CHANGED[0]} AND committed_at {CHANGED[1]} AND NOT EXISTS (SELECT 1 FROM deployments d WHERE d.started_at {CHANGED[0]} AND d.started_at {CHANGED[1]} AND d.service_id = c.service_id AND d.commit_sha = c.sha)")
def standalone_commits(spark, d):
    return changes.standalone_commits(S.commits(spark, d), S.deployments(spark, d), CHANGE_WINDOW.widened(60)).select("sha", "service_id", "committed_at")


@query(f"WITH {S.CHANGE_SQL} SELECT i.uid, i.applied_at, 'svc-' || i.service_id AS service FROM infra i WHERE applied_at {CHANGED[0]} AND applied_at {CHANGED[1]}")
def left_join_unattributed(spark, d):
    named = S.services(spark).select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    return changes.infra_in(S.infra_changes(spark, d), CHANGE_WINDOW.widened(60)).join(named, "service_id", "left").select("uid", "applied_at", "service")


_VECTOR = [round(((i * 37) % 64 - 32) / 100, 2) for i in range(64)]
_CHUNKS = f"""c AS (SELECT 'doc-' || label AS slug, vec_id::INT AS ordinal, vec_id % 7 = 0 AS res, 1 - list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]) AS distance FROM embeddings),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY distance, ordinal) AS place FROM c WHERE distance <= 1.2) WHERE place = 1)"""


@query(f"WITH {_CHUNKS} SELECT slug, ordinal, round(distance, 6) AS distance FROM best")
def nearest_chunks(spark, d):
    return similar.best_chunks(S.chunks(spark, d), _VECTOR, 1.2).select("slug", "ordinal", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_CHUNKS}, r AS (SELECT slug, min(ordinal) AS ro FROM c WHERE res GROUP BY 1)
  SELECT 'postmortem:' || b.slug || '@' || substr(sha256(b.slug), 1, 8) || '#' || ordinal AS cite, 'postmortem:' || b.slug || '@' || substr(sha256(b.slug), 1, 8) || '#' || ro AS resolution_cite,
    b.slug, 'Review ' || b.slug AS title, 'chunk ' || ordinal AS snippet, round(1 - distance, 6) AS similarity FROM best b LEFT JOIN r ON b.slug = r.slug ORDER BY distance, b.slug, ordinal LIMIT 5""")
def nearest_docs(spark, d):
    found = similar.search(S.postmortems(spark, d), S.chunks(spark, d), _VECTOR, 5, "svc-1", 1.2)
    return found.select("cite", "resolution_cite", "slug", "title", "snippet", F.round("similarity", 6).alias("similarity"))


@query("SELECT 'doc-' || label AS slug, min(vec_id)::INT AS resolution_ordinal FROM embeddings WHERE vec_id % 7 = 0 GROUP BY 1")
def resolution_lookup(spark, d):
    return similar.resolutions(S.chunks(spark, d))


@query("SELECT vec_id, abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) <= 0.001 AND len(embedding) = 64 AS valid FROM embeddings")
def vector_validation(spark, d):
    return S.read(spark, d, "embeddings").select("vec_id", vectors.valid(F.col("embedding"), 64).alias("valid"))


_NAMES = "CASE lower(n) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.LEVEL_NAMES.items()) + " END"


@query(f"""WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'WARN' WHEN 1 THEN 'crit' WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Notice' END AS n, 100 + event_id % 600 AS c FROM events)
  SELECT event_id, CASE WHEN length(n) > 0 THEN coalesce({_NAMES}, 'info') WHEN c BETWEEN 500 AND 599 THEN 'error' WHEN c BETWEEN 400 AND 499 THEN 'warning' ELSE 'info' END AS level,
    CASE WHEN c BETWEEN 100 AND 599 THEN (c // 100)::VARCHAR || 'xx' ELSE 'none' END AS status_class FROM e""")
def level_map(spark, d):
    e = S.read(spark, d, "events")
    names = F.element_at(F.array(F.lit(" WARN "), F.lit("crit"), F.col("event_type"), F.lit(""), F.lit(None), F.lit("Notice")), (F.col("event_id") % 6 + 1).cast("int"))
    code = (F.lit(100) + F.col("event_id") % 600).cast("int")
    return e.select("event_id", texts.canonical_level(names, code).alias("level"), texts.status_class(code).alias("status_class"))


@query("SELECT event_id, substr(sha256(event_type || ' by user <NUM> event <NUM>'), 1, 32) AS template_hash FROM events")
def template_hash(spark, d):
    return S.log_events(spark, d, templates=True).select(F.col("id").alias("event_id"), "template_hash")


@query("SELECT substr(sha256(event_type || ' by user <NUM> event <NUM>'), 1, 32) AS template_hash, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY 1")
def template_hash_groups(spark, d):
    return S.log_events(spark, d, templates=True).groupBy("template_hash").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


def _mask_patterns() -> dict[str, str]:
    """The mask's branches for the SQL engine, whose patterns know no lookahead and ASCII word edges only; word characters beyond ASCII are underscores by then."""
    hexed = "|".join([rf"[0-9]{{{k}}}[a-fA-F][0-9a-fA-F]{{{7 - k},}}" for k in range(7)] + ["[0-9]{7,}[a-fA-F][0-9a-fA-F]*"])
    own = {"HEX": rf"0[xX][0-9a-fA-F]+\b|\b(?:{hexed})\b"}
    return {name: own.get(name, pattern).replace(r"[^\s", r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}") for name, pattern in texts.MASKS}


def mask_sql(rows: str, key: str, column: str) -> str:
    """(key, masked) of the rows: tokens are found in a copy whose word characters beyond ASCII are underscores, gaps are cut from the text itself."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    branches = _mask_patterns()
    every = quoted("|".join(f"(?:{p})" for p in branches.values()))
    names = " ".join(f"WHEN regexp_full_match(token, {quoted(p)}) THEN '<{n}>'" for n, p in [("NUM", branches["NUM"]), *branches.items()])
    listed = "|".join(branches)
    return f"""WITH apart AS (SELECT {key}, regexp_replace({column}, '<({listed})>', '<ESC\\1>', 'g') AS o FROM {rows}),
      plain AS (SELECT *, regexp_replace(regexp_replace(o, '[^\\x00-\\x7F\\P{{L}}]', '_', 'g'), '[^\\x00-\\x7F\\P{{N}}]', '_', 'g') AS m FROM apart),
      cut AS (SELECT {key}, o, unnest(regexp_split_to_array(m, {every})) AS gap, unnest(list_append(regexp_extract_all(m, {every}), '')) AS token, generate_subscripts(regexp_split_to_array(m, {every}), 1) AS i FROM plain),
      placed AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY {key} ORDER BY i) - length(gap) - length(token) AS before FROM cut),
      named AS (SELECT *, substr(o, before::BIGINT + 1, length(gap)) || CASE WHEN token = '' THEN '' {names} ELSE '<HOSTPORT>' END AS part FROM placed)
      SELECT {key}, trim(regexp_replace(string_agg(part, '' ORDER BY i), '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS masked FROM named GROUP BY {key}"""


@query(f"SELECT doc_id, substr(sha256(masked), 1, 32) AS template_hash FROM ({mask_sql('documents', 'doc_id', 'text')})")
def template_mask(spark, d):
    """Templates of free text."""
    return S.read(spark, d, "documents").select("doc_id", texts.template_hash(texts.mask("text")).alias("template_hash"))


#: Messages with every kind of token, by the event's number; {i} and {u} are the event's and the user's.
_TOKENS = (
    "at 2026-08-19T14:03:22.{i}Z and 2026-08-19 14:03:22+02:00", "GET https://a.b/c?u={u} <URL>", "mail x.{u}+y@z-{i}.org", "id 0f8fad5b-d9cb-469f-a165-0000{i}8950e", "dead{i}beef at 0x{i}f, {i}",
    "from 10.0.{u}.1:80 by [fe80::1]:{i}", "host-{u}.local:{i} refused x-y.z:1", "/var/log/{u}.log /one", r"""say "a \" {i} b" and 'c {u}'""", "took -{i}ms or {u}.5s", "used {i}GiB of 9KB", "  {i}\t-7  été {u}  ",
)
_FILLED = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in _TOKENS) + f"][event_id % {len(_TOKENS)} + 1]"


@query(mask_sql(f"(SELECT event_id, replace(replace({_FILLED}, '{{i}}', event_id::VARCHAR), '{{u}}', user_id::VARCHAR) AS message FROM events)", "event_id", "message"))
def template_branches(spark, d):
    """Templates of messages that have every kind of token."""
    made = F.element_at(F.array(*map(F.lit, _TOKENS)), (F.col("event_id") % len(_TOKENS) + 1).cast("int"))
    filled = F.replace(F.replace(made, F.lit("{i}"), F.col("event_id").cast("string")), F.lit("{u}"), F.col("user_id").cast("string"))
    return S.read(spark, d, "events").select("event_id", texts.mask(filled).alias("masked"))


_BLOCKS = """WITH e AS (SELECT *, CASE WHEN extract(minute FROM ts) >= 0 THEN date_trunc('hour', ts)::TIMESTAMP + to_minutes((extract(minute FROM ts)::BIGINT // 5) * 5) END AS b FROM events),
  k AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'p-' || (event_id % 40) ELSE 'fp:' || substr(sha256('svc-' || (user_id % 10) || '|errors|' || strftime(b, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 32) END AS dedup_key FROM e)"""


@query(f"{_BLOCKS} SELECT dedup_key, min(event_id) AS winner, count(*) AS alerts FROM k GROUP BY 1")
def dedup_alerts(spark, d):
    from evidentry.sources.webhooks import dedup_key

    e = S.read(spark, d, "events")
    provider = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("p-"), (F.col("event_id") % 40).cast("string")))
    key = dedup_key(F.lit(None).cast("string"), provider, F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")), F.lit("errors"), F.col("ts"))
    return e.select("event_id", key.alias("dedup_key")).groupBy("dedup_key").agg(F.min("event_id").alias("winner"), F.count("*").alias("alerts"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_orderpriority || 'x' FROM orders WHERE o_orderkey % 30 = 3),
  s AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 2 = 1)
  SELECT CASE WHEN s.k IS NULL THEN 'inserted' WHEN s.v = b.v THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS n FROM b LEFT JOIN s ON b.k = s.k GROUP BY 1""")
def immutable_conflicts(spark, d):
    o = S.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("v"), "o_orderkey")
    batch = o.where("o_orderkey % 3 <> 0").union(o.where("o_orderkey % 30 = 3").withColumn("v", F.concat("v", F.lit("x")))).drop("o_orderkey")
    return split_batch(batch, o.where("o_orderkey % 2 = 1").drop("o_orderkey"), "uid", ("v",)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.s AS before, b.s AS after FROM (VALUES ('in_progress'), ('success'), ('failed'), ('rolled_back')) a(s), (VALUES ('in_progress'), ('success'), ('failed'), ('rolled_back')) b(s))
  SELECT before, after, (before = 'in_progress' AND after <> 'in_progress') OR (before = 'success' AND after = 'rolled_back') AS permitted FROM p""")
def lifecycle_transitions(spark, d):
    return transitions(spark)


@query("SELECT user_id::VARCHAR AS event_uid, max(row(json_extract_string(props, '$.k')::BIGINT, event_id))[1]::BIGINT AS occurrence_count, arg_max(event_id, row(json_extract_string(props, '$.k')::BIGINT, event_id)) AS id FROM events GROUP BY 1".replace("max(row(json_extract_string(props, '$.k')::BIGINT, event_id))[1]", "max(json_extract_string(props, '$.k')::BIGINT)"))
def snapshot_replacement(spark, d):
    e = S.read(spark, d, "events").select(F.col("user_id").cast("string").alias("event_uid"), F.get_json_object("props", "$.k").cast("long").alias("occurrence_count"), F.col("event_id").alias("id"))
    return latest_snapshot(e, "event_uid", "occurrence_count", "id").select("event_uid", "occurrence_count", "id")


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'unparseable' WHEN event_id % 4 = 1 THEN 'no_timestamp' ELSE 'no_service_match' END AS reason, count(*) AS n FROM events GROUP BY 1")
def unresolved_by_reason(spark, d):
    from evidentry.operators.store import unresolved_report

    e = S.read(spark, d, "events")
    reason = F.when(F.col("event_id") % 4 == 0, "unparseable").when(F.col("event_id") % 4 == 1, "no_timestamp").otherwise("no_service_match")
    return unresolved_report(e.select(reason.alias("reason")))


@query("""WITH f AS (SELECT l_orderkey AS k, l_partkey || '/' || l_linenumber AS path, sum(l_quantity::INT)::INT AS adds, sum((l_tax * 100)::INT)::INT AS dels FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY -(adds + dels), path) AS place FROM f)
  SELECT k AS l_orderkey, count(*) AS files, sum(adds)::BIGINT AS additions, sum(dels)::BIGINT AS deletions, string_agg(path, ',' ORDER BY path) FILTER (WHERE place <= 2) AS kept FROM r GROUP BY 1""")
def commit_hunk_rank(spark, d):
    from evidentry.sources.git import capped_files

    lines = S.read(spark, d, "lineitem").groupBy("l_orderkey", F.concat_ws("/", "l_partkey", "l_linenumber").alias("path"))
    changes_ = lines.agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("adds"), F.sum(F.round(F.col("l_tax") * 100).cast("int")).cast("int").alias("dels"))
    file = F.struct("path", F.lit("modified").alias("status"), F.col("adds").alias("additions"), F.col("dels").alias("deletions"), F.lit("@@ -1 +1 @@").alias("hunks"))
    commits = changes_.groupBy("l_orderkey").agg(F.collect_list(file).alias("files"))  # an order has a few lines
    capped = commits.withColumn("files", capped_files(F.col("files"), max_files=2))
    total = lambda key: F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f[key])
    kept = F.transform(F.filter("files", lambda f: f["hunks"].isNotNull()), lambda f: f["path"])
    return capped.select("l_orderkey", F.size("files").cast("long").alias("files"), total("additions").alias("additions"), total("deletions").alias("deletions"), F.array_join(kept, ",").alias("kept"))


@query(f"WITH {S.LOG_SQL} SELECT cite FROM rollups UNION ALL SELECT 'log:' || uid FROM log_events UNION ALL SELECT 'commit:' || sha1(o_orderkey::VARCHAR) FROM orders")
def citations_format(spark, d):
    r = _rollups(spark, d).withColumn("service", F.concat(F.lit("svc-"), F.col("service_id").cast("string")))
    keys = ("service", "bucket_start", "status_class", "level", "template_hash")
    parts = [r.select(citations.rollup(*map(F.col, keys)).alias("cite")), S.log_events(spark, d).select(citations.log(F.col("uid")).alias("cite")), S.commits(spark, d).select(citations.commit(F.col("sha")).alias("cite"))]
    return parts[0].union(parts[1]).union(parts[2])


_MADE = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'commit:' || sha1(event_id::VARCHAR) WHEN 1 THEN 'log:' || md5(event_id::VARCHAR) WHEN 2 THEN 'deploy:' || upper(md5(event_id::VARCHAR))
    WHEN 3 THEN 'rollup:svc-1/2024-01-0' || (event_id % 9) || 'T00:00:00Z/5xx/error/abc' WHEN 4 THEN 'postmortem:a.b@' || substr(md5(event_id::VARCHAR), 1, 8) || '#' || event_id WHEN 5 THEN 'other:' || event_id ELSE 'postmortem:x@' || substr(md5(event_id::VARCHAR), 1, 8) || '#0' || event_id END AS cite FROM events"""


def _made(spark, d):
    i = F.col("event_id")
    t = i.cast("string")
    made = [
        F.concat(F.lit("commit:"), F.sha1(t)), F.concat(F.lit("log:"), F.md5(t)), F.concat(F.lit("deploy:"), F.upper(F.md5(t))),
        F.concat(F.lit("rollup:svc-1/2024-01-0"), (i % 9).cast("string"), F.lit("T00:00:00Z/5xx/error/abc")),
        F.concat(F.lit("postmortem:a.b@"), F.substring(F.md5(t), 1, 8), F.lit("#"), t), F.concat(F.lit("other:"), t), F.concat(F.lit("postmortem:x@"), F.substring(F.md5(t), 1, 8), F.lit("#0"), t),
    ]
    return S.read(spark, d, "events").select("event_id", F.element_at(F.array(*made), (i % 7 + 1).cast("int")).alias("cite"))


@query(f"""WITH m AS ({_MADE}) SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'commit' WHEN 1 THEN 'log' WHEN 3 THEN CASE WHEN event_id % 9 > 0 THEN 'rollup' END WHEN 4 THEN 'postmortem' END AS kind,
  CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN CASE WHEN event_id % 9 > 0 THEN 5 END WHEN 4 THEN 3 END AS parts FROM m""")
def citations_parse(spark, d):
    return _made(spark, d).select("event_id", citations.kind(F.col("cite")).alias("kind"), F.size(citations.components(F.col("cite"))).alias("parts")).withColumn("parts", F.when(F.col("kind").isNotNull(), F.col("parts")))


@query(f"WITH m AS ({_MADE}) SELECT DISTINCT cite, event_id % 7 IN (0, 1, 4) OR (event_id % 7 = 3 AND event_id % 9 > 0) AS well_formed FROM m WHERE cite NOT IN (SELECT cite FROM m WHERE event_id % 2 = 0)")
def provenance_anti(spark, d):
    made = _made(spark, d)
    return provenance.unsupported(made, made.where("event_id % 2 = 0"))


@query("""WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations)
  SELECT conv_id, record::BIGINT AS record, min(turn) AS first_turn, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM c GROUP BY 1, 2""")
def islands_records(spark, d):
    from evidentry.sources.lines import records_by_header

    c = S.read(spark, d, "conversations").select(F.col("conv_id").alias("source_file"), F.col("turn").alias("source_offset"), F.col("text").alias("raw"), (F.col("role") == "user").alias("is_header"))
    found = records_by_header(c)
    return found.groupBy(F.col("source_file").alias("conv_id"), "record").agg(F.min("source_offset").alias("first_turn"), F.count("*").alias("lines"), F.sum(F.length("raw")).alias("chars"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 2) AS host, regexp_extract(url, '^([a-z]+)://([^/?#]+)([^?#]*)', 3) AS path FROM pages""")
def url_parse(spark, d):
    parts = lambda i: F.regexp_extract("url", "^([a-z]+)://([^/?#]+)([^?#]*)", i)
    return S.read(spark, d, "pages").select("page_id", parts(1).alias("scheme"), parts(2).alias("host"), parts(3).alias("path"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, substr(sha256('{"action":"' || CASE WHEN l_linenumber % 2 = 0 THEN 'update' ELSE 'create' END || '","apply_id":"a-' || l_orderkey || '","kind":"infra","provider":"terraform","resource_name":"part.\\"' || l_partkey || '\\"","resource_type":"part","v":1}'), 1, 32) AS uid FROM lineitem""")
def uid_hash(spark, d):
    line = S.read(spark, d, "lineitem")
    action = F.when(F.col("l_linenumber") % 2 == 0, "update").otherwise("create")
    name = F.concat(F.lit('part."'), F.col("l_partkey").cast("string"), F.lit('"'))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", infra_uid(F.concat(F.lit("a-"), F.col("l_orderkey").cast("string")), F.lit("part"), name, action, F.lit("terraform")).alias("uid"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN contains(substr(text, 1, 500), ' ') THEN substr(text, 1, 500 - strpos(reverse(substr(text, 1, 500)), ' ')) ELSE substr(text, 1, 500) END AS snippet FROM documents")
def snippet(spark, d):
    return S.read(spark, d, "documents").select("doc_id", texts.snippet(F.col("text")).alias("snippet"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  SELECT doc_id, (i - 1)::INT AS ordinal, 'section' AS kind, length(regexp_replace('## ' || line, '\\s+$', ''))::INT AS chars FROM s""")
def line_chunks(spark, d):
    """Every line of a document as a section of a review, through the chunker."""
    from evidentry.sources.postmortems import chunks_of

    body = F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return S.read(spark, d, "documents").select("doc_id", F.posexplode(chunks_of(body, F.lit(1 << 30))).alias("ordinal", "c")).select("doc_id", "ordinal", "c.kind", F.length("c.content").alias("chars"))


@query("""SELECT page_id, regexp_replace(replace(url, '://', '://u' || page_id || ':pw' || page_id || '@'), '(://[^:/@]+):[^@/]*@', '\\1:***@') AS url FROM pages""")
def url_redaction(spark, d):
    login = F.concat(F.lit("://u"), F.col("page_id").cast("string"), F.lit(":pw"), F.col("page_id").cast("string"), F.lit("@"))
    return S.read(spark, d, "pages").select("page_id", texts.redact_url(F.replace("url", F.lit("://"), login)).alias("url"))


@query("""SELECT event_id, event_id % 5 IN (0) AS stack_array, event_id % 5 = 1 AS upstream_string, event_id % 5 = 0 AS duration_number, FALSE AS exc_string,
  CASE event_id % 5 WHEN 0 THEN 'array' WHEN 3 THEN 'string' END AS stack_kind, CASE WHEN event_id % 5 = 1 THEN 'null' END AS exc_kind FROM events""")
def json_type_predicates(spark, d):
    e, a = S.log_events(spark, d), F.col("attrs")
    return e.select(
        F.col("id").alias("event_id"),
        rollups.is_kind(a, "stack", "array").alias("stack_array"),
        rollups.is_kind(a, "upstream", "string").alias("upstream_string"),
        rollups.is_kind(a, "duration_ms", "number").alias("duration_number"),
        rollups.is_kind(a, "exc_type", "string").alias("exc_string"),
        rollups.json_kind(a, "stack").alias("stack_kind"),
        rollups.json_kind(a, "exc_type").alias("exc_kind"),
    )


@query()
def dst_attach(spark, d):
    """Wall clocks of the weeks around New York's changes of 2026, as instants with both flags; tested against a time-zone library."""
    start = F.lit(datetime(2026, 3, 1)).cast("timestamp")
    local = spark.range(8640).select((start + F.make_dt_interval(mins=(F.col("id") * 40).cast("int"))).alias("local"))
    instant, ambiguous, missing = times.attach_zone(F.col("local"), F.lit("America/New_York"))
    return local.select(F.col("local").cast("timestamp_ntz").alias("local"), instant.cast("timestamp_ntz").alias("instant"), ambiguous.alias("tz_ambiguous"), missing.alias("tz_nonexistent"))


@query("""SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS low, CASE WHEN date_trunc('minute', ts)::TIMESTAMP = ts THEN ts ELSE date_trunc('minute', ts)::TIMESTAMP + INTERVAL 1 MINUTE END AS high FROM events""")
def window_snap(spark, d):
    low = times.minute_ntz("ts")
    return S.read(spark, d, "events").select("event_id", low.alias("low"), F.when(low == F.col("ts"), F.col("ts")).otherwise(low + F.expr("INTERVAL 1 MINUTE")).alias("high"))


@query("SELECT lang AS source, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) AS records FROM documents GROUP BY 1")
def cursor_bytes(spark, d):
    from evidentry.operators.store import consumed_bytes

    docs = S.read(spark, d, "documents").select(F.col("lang").alias("source"), F.col("text").alias("raw"))
    return consumed_bytes(docs, "source")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def non_zero_counts(spark, d):
    from evidentry.operators.integrity import source_counts

    return source_counts({n: S.read(spark, d, n) for n in ("orders", "lineitem", "events")})


@query(f"""WITH {S.LOG_SQL}, n AS (SELECT template_hash, sum(count)::BIGINT AS c FROM rollups WHERE {IN} GROUP BY 1), b AS (SELECT template_hash, sum(count)::BIGINT AS c FROM rollups WHERE {BEFORE} GROUP BY 1)
  SELECT coalesce(n.template_hash, b.template_hash) AS template_hash, coalesce(n.c, 0) AS count, coalesce(b.c, 0) AS baseline_count FROM n FULL JOIN b ON n.template_hash = b.template_hash""")
def conditional_full_outer(spark, d):
    both = times.Window(WINDOW.before().start, WINDOW.end)
    now = F.col("bucket_start") >= F.lit(WINDOW.start)
    rows = rollups.rollup(S.log_events(spark, d).where(both.holds(F.col("ts"))), bucket=times.minute_ntz("ts"))
    return rows.groupBy("template_hash").agg(F.coalesce(F.sum(F.when(now, F.col("count"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~now, F.col("count"))), F.lit(0)).alias("baseline_count"))


@query("""WITH t AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT s_suppkey, (1 + (s_nationkey % 5 = n_regionkey)::INT)::BIGINT AS tag_matches FROM t""")
def tag_containment(spark, d):
    """Services want a region, and one of them a residue besides; suppliers carry both tags."""
    region = F.col("n_regionkey").cast("string")
    want = S.read(spark, d, "nation").select("n_regionkey").distinct().select((F.col("n_regionkey") * 2).alias("id"), F.create_map(F.lit("region"), region).alias("infra_tags"))
    both = S.read(spark, d, "nation").select("n_regionkey").distinct().select((F.col("n_regionkey") * 2 + 1).alias("id"), F.create_map(F.lit("region"), region, F.lit("residue"), region).alias("infra_tags"))
    s = S.read(spark, d, "supplier").join(S.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    records = s.select("s_suppkey", F.create_map(F.lit("region"), region, F.lit("residue"), (F.col("s_nationkey") % 5).cast("string"), F.lit("name"), F.col("s_name")).alias("infra_tags"))
    return resolve.tag_matches(records, want.union(both), "s_suppkey").select("s_suppkey", "tag_matches")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 60 < 30 THEN (c_custkey % 60)::INT END WHEN c_custkey % 3 = 1 THEN (c_custkey % 30)::INT ELSE (c_custkey % 30)::INT END AS service_id,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 60 >= 30 THEN 'no_service_match' END AS reason FROM customer""")
def service_resolve_priority(spark, d):
    i = F.col("id").cast("string")
    services = spark.range(30).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("svc-"), i).alias("name"), F.concat(F.lit("Org/Repo"), i, F.lit(".git")).alias("repo"), F.array(F.concat(F.lit("key-"), i)).alias("log_keys"),
        F.array(F.concat(F.lit("pod-"), i)).alias("k8s_names"), F.create_map(F.lit("app"), i).alias("infra_tags"), F.lit("UTC").alias("log_timezone"),
    )
    k = F.col("c_custkey")
    records = S.read(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 3 == 0, F.concat(F.lit("svc-"), (k % 60).cast("string"))).alias("name"),
        F.when(k % 3 == 1, F.concat(F.lit("pod-"), (k % 30).cast("string"), F.lit("-abcdefghij-k2k2k"))).alias("k8s_name"),
        F.when(k % 3 == 2, F.concat(F.lit("org/repo"), (k % 30).cast("string"))).alias("repo"),
        F.create_map(F.lit("app"), (k % 30).cast("string")).alias("infra_tags"),
    )
    return resolve.resolve(records, services, "c_custkey").select("c_custkey", "service_id", "reason")


@query("""WITH p AS (SELECT c_custkey, 'web-' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '-abcdefghij-k2k2k' WHEN 1 THEN '-7' ELSE '' END AS pod FROM customer)
  SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN pod || ',web' ELSE pod || ',web-' || c_custkey || ',web' END AS names FROM p""")
def pod_candidates(spark, d):
    k = F.col("c_custkey")
    suffix = F.when(k % 3 == 0, "-abcdefghij-k2k2k").when(k % 3 == 1, "-7").otherwise("")
    return S.read(spark, d, "customer").select("c_custkey", F.array_join(resolve.pod_candidates(F.concat(F.lit("web-"), k.cast("string"), suffix)), ",").alias("names"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    return doubled(S.read(spark, d, "lineitem"), "l_orderkey").withColumnRenamed("count", "n").select("l_orderkey", "n")


@query("SELECT 'orphan' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey % 97 = 1 UNION ALL SELECT 'status', count(*) FROM lineitem WHERE l_linestatus NOT IN ('F') UNION ALL SELECT 'quantity', count(*) FROM lineitem WHERE NOT l_quantity > 1")
def integrity_report(spark, d):
    line, orders = S.read(spark, d, "lineitem"), S.read(spark, d, "orders").where("o_orderkey % 97 <> 1")
    found = violations(line, {"status": F.col("l_linestatus").isin("F"), "quantity": F.col("l_quantity") > 1}, {"orphan": (orders, "l_orderkey", "o_orderkey")})
    return found


@query(f"WITH {S.LOG_SQL} SELECT id, substr(sha256(id::VARCHAR || '|' || uid || '|' || level), 1, 32) AS row_hash FROM log_events")
def canonical_rows_digest(spark, d):
    return S.log_events(spark, d).select("id", F.substring(F.sha2(F.concat_ws("|", "id", "uid", "level"), 256), 1, 32).alias("row_hash"))


@query("""WITH f AS (SELECT source AS file, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, CASE WHEN text LIKE '%%%%%' THEN 1 ELSE 0 END AS a, CASE WHEN text LIKE 'The%' THEN 1 ELSE 0 END AS b FROM documents WHERE trim(text) <> '')
  SELECT file, CASE WHEN avg(a) >= avg(b) THEN 'marked' ELSE 'plain' END AS format FROM f WHERE r <= 20 GROUP BY 1""".replace("'%%%%%'", "'%!%%!%%' ESCAPE '!'"))
def sniff_formats(spark, d):
    from evidentry.sources.formats import best_format

    lines = S.read(spark, d, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("source_offset"), F.col("text").alias("raw"))
    return best_format(lines, {"marked": F.col("raw").contains("%%"), "plain": F.startswith("raw", F.lit("The"))}).withColumnRenamed("source_file", "file")


_ROW = "sha256(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey)::VARCHAR)"


@query(f"""WITH h AS (SELECT {_ROW} AS h FROM nation), s AS (SELECT count(*) AS n, {", ".join(f"sum(('0x' || substr(h, {at}, 15))::UBIGINT)::VARCHAR AS s{i}" for i, at in enumerate((1, 16, 31)))} FROM h)
  SELECT sha256('nation:' || n || ':' || s0 || ':' || s1 || ':' || s2) AS digest FROM s""")
def replay_digest(spark, d):
    columns = ["n_name", "n_nationkey", "n_regionkey"]
    return spark.createDataFrame([(provenance.replay_digest({"nation": S.read(spark, d, "nation").select(*columns)}),)], "digest string")


from evidentry.plans import ingest_queries, interface_queries  # noqa: E402, F401  register their queries
