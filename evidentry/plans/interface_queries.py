"""The query interfaces whole, and the mappings of exports and cluster snapshots, over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentry import schemas
from evidentry.operators import rollups
from evidentry.operators.store import EvidenceStore, apply_deployments, insert_new
from evidentry.plans import standins as S
from evidentry.plans.catalog import _ANOMALIES, IN, ORACLES, SERVICE, query
from evidentry.plans.envelopes import QueryInterface
from evidentry.session import scratch_path
from evidentry.sources import git, k8s


def _filled(rows, ddl: str):
    """``rows`` with the columns and types of a table; what they lack is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])


def _services(spark):
    """Services with a repository and with the name of their pods."""
    letter = F.substring(F.lit("abcdefghij"), F.col("id") + 1, F.lit(1))
    made = S.services(spark).withColumns({"repo": F.concat(F.lit("org/repo-"), F.col("id").cast("string")), "k8s_names": F.array(F.concat(F.lit("web-"), letter)), "log_timezone": F.lit("UTC")})
    return _filled(made, schemas.SERVICES)


def _interface(spark, **tables) -> QueryInterface:
    store = EvidenceStore(spark, scratch_path(spark, "evidence"))
    store.publish({"services": _services(spark)} | {n: _filled(rows, store.tables[n]) for n, rows in tables.items()})
    return QueryInterface(store)


def _body(name: str) -> str:
    """A telemetry query's SQL without the tables it begins with."""
    return ORACLES[name].removeprefix(f"WITH {S.LOG_SQL}")


@query(f"""{_ANOMALIES},
  own AS (SELECT * FROM rollups WHERE service = 'svc-3' AND {IN}),
  occurred AS ({_body("occurrence_count")}),
  ranked AS (SELECT f.*, o.occurrence_count, count - baseline_count AS delta, (status_class = '5xx' OR level IN ('error', 'fatal')) AS is_error FROM found f LEFT JOIN occurred o USING (template_hash, level)),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_error ORDER BY delta DESC, count DESC, template_hash, status_class, level) AS rank FROM ranked) WHERE rank <= 2),
  traces AS ({_body("sample_traces")})
  SELECT 'series' AS section, row_number() OVER (ORDER BY bucket_start, status_class)::INT AS place, strftime(bucket_start, '%Y-%m-%dT%H:%M:%SZ') || ' ' || status_class AS name, sum(count)::BIGINT AS n, string_agg(cite, ',' ORDER BY cite) AS cites FROM own GROUP BY bucket_start, status_class
  UNION ALL SELECT 'status', row_number() OVER (ORDER BY status_class)::INT, status_class, sum(count)::BIGINT, string_agg(cite, ',' ORDER BY cite) FROM own GROUP BY status_class
  UNION ALL SELECT 'template', row_number() OVER (ORDER BY is_error DESC, rank)::INT, status_class || ' ' || level || ' ' || template_hash || ' ' || baseline_count || ' ' || delta || ' ' || coalesce(occurrence_count::VARCHAR, '-') || ' ' || exemplar_cite, count, source_cites FROM top
  UNION ALL SELECT 'trace', row_number() OVER (ORDER BY ts, uid)::INT, trace_id, NULL, '' FROM traces
  UNION ALL SELECT 'baseline sparse', 1, ({_body("baseline_sparse")})::VARCHAR, NULL, ''""")
def error_telemetry(spark, d):
    """The telemetry response for a service and a window, a row for each of its entries in their order."""
    events = S.log_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    found = _interface(spark, log_events=events, rollups=rollups.rollup(events)).get_error_telemetry(SERVICE, "2024-01-16T00:00:20Z", "2024-01-18T00:00:05Z", top_n=2)
    rows = [("series", i, f"{x['bucket_start']} {x['status_class']}", x["count"], ",".join(x["source_cites"])) for i, x in enumerate(found["series"], 1)]
    rows += [("status", i, x["status_class"], x["count"], ",".join(x["source_cites"])) for i, x in enumerate(found["status_breakdown"], 1)]
    for i, x in enumerate(found["top_templates"], 1):
        occurred = "-" if x["occurrence_count"] is None else x["occurrence_count"]
        name = f"{x['status_class']} {x['level']} {x['template_hash']} {x['baseline_count']} {x['delta']} {occurred} {x['exemplar']['cite']}"
        rows.append(("template", i, name, x["count"], ",".join(x["source_cites"])))
    rows += [("trace", i, x, None, "") for i, x in enumerate(found["sample_trace_ids"], 1)]
    rows.append(("baseline sparse", 1, str(found["baseline_sparse"]).lower(), None, ""))
    return spark.createDataFrame(rows, "section string, place int, name string, n long, cites string")


@query(f"""{ORACLES["incident_changes"].rsplit("SELECT service_id, kind", 1)[0]}
  SELECT CASE WHEN service_id IS NULL THEN 'unattributed' WHEN service_id = 3 THEN 'focus' ELSE 'other' END AS block, coalesce('svc-' || service_id, '') AS service, kind,
    row_number() OVER (PARTITION BY service_id, kind ORDER BY "at" DESC, cite)::INT AS place, cite FROM stream""")
def incident_diff(spark, d):
    """The response on what changed around a window, a row for each change in its block's order."""
    asked = _interface(spark, commits=S.commits(spark, d), deployments=S.deployments(spark, d), infra_changes=S.infra_changes(spark, d))
    found = asked.get_incident_diff(SERVICE, "1998-03-01T00:00:00Z", "1998-03-15T00:00:00Z")
    kinds = {"commits": "commit", "deployments": "deployment", "infra_changes": "infra"}
    blocks = [("focus", found["focus"]), *[("other", b) for b in found["other_services"]], ("unattributed", {"service": "", "infra_changes": found["unattributed"]})]
    rows = [(name, b["service"], kind, i, x["cite"]) for name, b in blocks for key, kind in kinds.items() for i, x in enumerate(b.get(key, []), 1)]
    return spark.createDataFrame(rows, "block string, service string, kind string, place int, cite string")


def _items(rows, item):
    return rows.select(F.lit("logs/cluster.json").alias("source_file"), (F.col("event_id") * 64).alias("source_offset"), F.to_json(item).alias("raw"))


def _pod():
    """A pod of the service, or of none for every seventh event."""
    letter = F.substring(F.lit("abcdefghij"), (F.col("user_id") % 10 + 1).cast("int"), F.lit(1))
    return F.when(F.col("event_id") % 7 == 0, "ghost-0").otherwise(F.concat(F.lit("web-"), letter, F.lit("-7d9f8b6c54-abcde")))


def _second():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query("""SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, (user_id % 10)::INT AS service_id, 'error' AS level, 'OOMKilled: container c' || (event_id % 2) || ' terminated (exit 137)' AS message, (event_id % 4)::INT AS restarts
  FROM events WHERE event_id % 3 > 0 AND event_id % 7 > 0""")
def pod_terminations(spark, d):
    """Pods of every event; of two in three a container was terminated."""
    i = F.col("event_id")
    ended = F.when(i % 3 > 0, F.struct(F.lit("OOMKilled").alias("reason"), F.lit(137).alias("exitCode"), _second().alias("finishedAt")))
    state = F.struct(F.concat(F.lit("c"), (i % 2).cast("string")).alias("name"), (i % 4).alias("restartCount"), F.struct(ended.alias("terminated")).alias("lastState"))
    pod = F.struct(F.struct(F.concat(F.lit("p-"), i.cast("string")).alias("uid"), _pod().alias("name")).alias("metadata"), F.struct(F.array(state).alias("containerStatuses")).alias("status"))
    found = k8s.pod_drafts(_items(S.read(spark, d, "events"), pod), _services(spark))
    return found.select((F.col("source_offset") / 64).cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "service_id", "level", "message", F.get_json_object("attrs", "$.restart_count").cast("int").alias("restarts"))


@query("""SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, (user_id % 10)::INT AS service_id, CASE WHEN event_id % 2 = 0 THEN 'warning' ELSE 'info' END AS level, 'BackOff: ' || event_type AS message,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 50 END::BIGINT AS occurrence_count FROM events WHERE event_id % 7 > 0""")
def cluster_events(spark, d):
    """An event of the cluster for every event; its time is in one of three places, and its count may be missing."""
    i = F.col("event_id")
    item = F.struct(
        F.struct(F.concat(F.lit("e-"), i.cast("string")).alias("uid")).alias("metadata"), F.struct(_pod().alias("name")).alias("involvedObject"), F.when(i % 2 == 0, "Warning").otherwise("Normal").alias("type"),
        F.lit("BackOff").alias("reason"), F.col("event_type").alias("message"), F.when(i % 5 > 0, i % 50).alias("count"), F.when(i % 3 == 0, _second()).alias("lastTimestamp"),
        F.when(i % 3 == 1, _second()).alias("eventTime"), F.when(i % 3 == 2, F.struct(_second().alias("lastObservedTime"))).alias("series"),
    )
    found = k8s.event_drafts(_items(S.read(spark, d, "events"), item), _services(spark))
    return found.select((F.col("source_offset") / 64).cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "service_id", "level", "message", "occurrence_count")


def _exports(spark, d):
    """An export of one commit and one deployment for every order."""
    k = F.col("o_orderkey")
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    file = lambda path, more, less, hunks: F.struct(F.lit(path).alias("path"), F.lit("modified").alias("status"), more.cast("int").alias("additions"), less.cast("int").alias("deletions"), hunks.cast("string").alias("hunks"))
    hunk = "@@ -1 +1 @@\n-a\n+b\n"
    files = F.array(file("src/b.py", k % 7, k % 3, F.when(k % 5 == 0, hunk * 4).otherwise(hunk)), file("src/a.py", F.lit(2), F.lit(0), F.lit(None)))
    sha = F.sha1(k.cast("string"))
    commit = F.struct(sha.alias("sha"), F.lit("a").alias("author"), at.alias("authored_at"), at.alias("committed_at"), F.col("o_orderpriority").alias("message"), F.lit(None).cast("int").alias("pr_number"), files.alias("files_changed"))
    deploy = F.struct(sha.alias("commit_sha"), F.col("o_orderstatus").alias("environment"), at.alias("started_at"), F.when(k % 2 == 0, at).alias("finished_at"), F.when(k % 2 == 0, "success").otherwise("in_progress").alias("status"))
    return S.read(spark, d, "orders").select(F.concat(F.lit("org/repo-"), (F.col("o_custkey") % 10).cast("string")).alias("repo"), F.array(commit).alias("commits"), F.array(deploy).alias("deploys"))


@query("""SELECT sha1(o_orderkey::VARCHAR) AS sha, (o_custkey % 10)::INT AS service_id, o_orderdate::TIMESTAMP AS committed_at, (o_orderkey % 7 + 2)::INT AS additions, (o_orderkey % 3)::INT AS deletions,
  'src/a.py webhook,src/b.py ' || CASE WHEN o_orderkey % 5 = 0 THEN 'budget' ELSE 'kept' END AS files FROM orders""")
def export_commits(spark, d):
    found = git.commits(_exports(spark, d), _services(spark))
    files = F.array_join(F.transform("files_changed", lambda f: F.concat(f["path"], F.lit(" "), F.coalesce(f["hunks_omitted"], F.lit("kept")))), ",")
    return found.select("sha", "service_id", F.col("committed_at").cast("timestamp_ntz").alias("committed_at"), "additions", "deletions", files.alias("files"))


@query("""SELECT sha1(o_orderkey::VARCHAR) AS commit_sha, (o_custkey % 10)::INT AS service_id, o_orderstatus AS environment, o_orderdate::TIMESTAMP AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::TIMESTAMP END AS finished_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'in_progress' END AS status FROM orders""")
def export_deployments(spark, d):
    found = git.deployments(_exports(spark, d), _services(spark))
    return found.select("commit_sha", "service_id", "environment", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")], "status")


@query("""SELECT DISTINCT substr(sha256('deploy:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 32) || CASE WHEN l_linestatus = 'F' THEN ' success' ELSE ' in_progress' END AS uid, (l_suppkey % 10)::INT AS service_id,
  CASE WHEN l_linestatus <> 'F' AND (l_suppkey % 10) % 3 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN l_linestatus <> 'F' THEN TIMESTAMP '2030-01-01 00:00:00' END AS finished_at
  FROM lineitem WHERE l_suppkey % 2 = 0 OR l_linestatus <> 'F'""")
def deployment_steps(spark, d):
    """Deployments of every second service are stored; then all that were under way end, half of them unseen before."""
    made = _filled(S.deployments(spark, d).withColumn("uid", F.concat_ws(" ", "uid", "status")), schemas.DEPLOYMENTS).dropDuplicates(["uid"])
    status = F.when(F.col("service_id") % 3 == 0, "failed").otherwise("success")
    ended = made.where("status = 'in_progress'").withColumns({"finished_at": F.to_timestamp(F.lit("2030-01-01 00:00:00")), "status": status})
    return apply_deployments(made.where("service_id % 2 = 0"), ended).select("uid", "service_id", "status", F.col("finished_at").cast("timestamp_ntz").alias("finished_at"))


@query("""SELECT 'alert:' || (user_id % 10) || ':' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS dedup_key, CASE WHEN count(*) FILTER (WHERE event_id % 3 = 0) > 0 THEN 'stored' ELSE 'new' END AS status FROM events GROUP BY 1""")
def alert_inserts(spark, d):
    """Incidents of one event in three are stored; all events then add those of unseen keys and leave the others."""
    key = F.concat(F.lit("alert:"), (F.col("user_id") % 10).cast("string"), F.lit(":"), F.date_format("ts", "yyyyMMddHH"))
    e = S.read(spark, d, "events").select("event_id", key.alias("dedup_key"))
    stored = e.where("event_id % 3 = 0").select("dedup_key").distinct().withColumn("status", F.lit("stored"))
    return insert_new(stored, e.select("dedup_key").withColumn("status", F.lit("new")), "dedup_key")
