"""A small corpus through all sources, the store, the three queries and the stream."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from evidentry.functions.identity import python_uid
from evidentry.operators import provenance, store as S
from evidentry.operators.integrity import snapshot_report
from evidentry.operators.resolve import registry_conflicts, resolve
from evidentry.plans.envelopes import QueryError, QueryInterface, parse_time
from evidentry.plans import render, runs
from evidentry.plans.corpus import ingest_all, ingest_clusters
from evidentry.sources import formats, git, k8s, lines, postmortems, records, registry, terraform, webhooks
from evidentry.streaming.ingest import stream_alerts, stream_drafts

SERVICES = """
- {name: pay-api, repo: Org/Pay.git, log_keys: [pay], k8s_names: [pay], infra_tags: {app: pay}, log_timezone: UTC}
- {name: web-api, repo: org/web, k8s_names: [web]}
- {name: find-api, repo: org/find, log_timezone: America/New_York}
- {name: old-api, repo: org/old}
"""
JSON_LINES = [
    '{"ts":"2026-08-19T14:00:01Z","level":"error","service":"pay-api","msg":"timeout after 30ms","status":504,"trace_id":"t1","duration_ms":30,"upstream":"db"}',
    '{"ts":"2026-08-19T14:00:05Z","level":"error","service":"pay-api","msg":"timeout after 31ms","status":"504","trace_id":"t2"}',
    '{"ts":"2026-08-19T13:50:05Z","level":"info","service":"pay-api","msg":"ok","status":200,"duration_ms":"x","service":"pay-api"}',
    '{"ts":"2026-08-19T14:00:06Z","service":"nobody","msg":"x"}',
    '{"ts":"never","service":"pay-api","msg":"x"}',
    "not json",
    '{"ts":"2026-08-19T14:01:00Z","service":"pay-api","msg":"été","odd":{"b":1,"a":[2]}}',
]
NGINX = [
    '10.0.0.1 - - [19/Aug/2026:14:00:09 +0000] "GET /a/b HTTP/1.1" 503 12 "-" "x" rt=0.250 urt="0.1, 0.2"',
    '10.0.0.1 - - [19/Aug/2026:16:00:10 +0200] "GET /a/b HTTP/1.1" 200 12 "-" "x" rt=- urt=""',
    '10.0.0.1 - - [99/Aug/2026:14:00:10 +0000] "GET / HTTP/1.1" 200 1 "-" "x"',
    "broken",
]
LOGFMT = [
    'ts=2026-08-19T14:00:02Z level=warn service=old-api msg="pool low" status=200 pool=3',
    'ts=2026-08-19T14:00:03 msg="no zone" duration_ms=3',
    "level=info noise",
    'ts=2026-08-19T14:00:04Z msg="x" x="unclosed',
]
TRACE = """orphan line
2026-08-19 10:00:00,123 ERROR [find-api] app.index: failed
Traceback (most recent call last):
  File "/srv/app.py", line 3, in run
    go()
  File "/lib/dep.py", line 9
    deep()
ValueError: bad
more detail
2026-08-19 10:00:01,000 INFO [find-api] app.index: fine
2026-08-19 10:00:02,000 ERROR [other-api] app.index: mine?
2026-08-19 10:00:03,000 ERROR [find-api] app.index: cut
Traceback (most recent call last):
  File "/srv/app.py", line 4, in run
"""
GIT = {
    "repo": "org/pay",
    "commits": [{"sha": "a" * 40, "author": "x", "authored_at": "2026-08-19T12:00:00Z", "committed_at": "2026-08-19T13:30:00Z", "message": "m", "pr_number": None, "files_changed": [
        {"path": "b.py", "status": "modified", "additions": 5, "deletions": 1, "hunks": "@@ 1\n+x"}, {"path": "a.py", "status": "added", "additions": 1, "deletions": 0, "hunks": "@@\n@@\n@@\n@@\n"}, {"path": "c.py", "status": "added", "additions": 0, "deletions": 0, "hunks": None}]},
        {"sha": "b" * 40, "author": "x", "authored_at": "2026-08-01T12:00:00Z", "committed_at": "2026-08-01T13:30:00Z", "message": "n", "pr_number": 4, "files_changed": []}],
    "deploys": [{"commit_sha": "b" * 40, "environment": "prod", "started_at": "2026-08-19T13:45:00Z", "finished_at": None, "status": "in_progress"}, {"commit_sha": "b" * 40, "environment": "prod", "started_at": "2026-08-19T14:10:00Z", "finished_at": None, "status": "success"}],
}
PLAN = {"resource_changes": [
    {"address": "db.pool", "type": "db", "provider_name": "p", "change": {"actions": ["update"], "before": {"size": 5, "tags": {"app": "pay"}, "key": "s"}, "after": {"size": 2, "tags": {"app": "pay", "x": "y"}, "key": "t"}, "after_unknown": {}, "before_sensitive": {"key": True}, "after_sensitive": {}}},
    {"address": "db.old", "type": "db", "change": {"actions": ["delete", "create"], "before": {"n": 1}, "after": None}},
    {"address": "db.same", "type": "db", "change": {"actions": ["no-op"], "before": {}, "after": {}}}]}
APPLIES = [{"apply_id": "ap1", "plan_file": "plan.json", "status": "success", "applied_at": "2026-08-19T13:40:00Z"}, {"apply_id": "ap2", "plan_file": "plan.json", "status": "failed", "applied_at": "2026-08-19T13:41:00Z"}]
PODS = [{"metadata": {"uid": "u1", "name": "web-abcdefghij-k2k2k"}, "status": {"containerStatuses": [{"name": "c", "restartCount": 2, "lastState": {"terminated": {"reason": "OOMKilled", "exitCode": 137, "finishedAt": "2026-08-19T14:02:00Z"}}}, {"name": "d", "restartCount": 0, "lastState": {}}]}}, {"metadata": {"uid": "u2", "name": "stranger"}, "status": {"containerStatuses": []}}]
EVENTS = {"kind": "List", "items": [{"metadata": {"uid": "ev1"}, "involvedObject": {"name": "web-3"}, "type": "Warning", "reason": "BackOff", "message": "bäck off 7 times", "count": 7, "lastTimestamp": "2026-08-19T14:03:00Z"}, {"metadata": {"uid": "ev2"}, "involvedObject": {"name": "web"}, "type": "Normal", "reason": "Pulled", "message": "image", "lastTimestamp": None, "eventTime": "2026-08-19T14:03:30Z"}]}
REVIEW = "---\ntitle: Pool\noccurred_at: 2026-01-02T03:04:05Z\nservices: [pay-api]\n---\nintro\n\n## Cause\n\nthe pool\n\n## Resolution\n\nraise it\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for d in ("logs", "git", "plans", "k8s", "reviews", "alerts"):
        (root / d).mkdir()
    (root / "services.yaml").write_text(SERVICES)
    (root / "logs/app.log").write_text("\r\n".join(JSON_LINES) + "\r\n")
    (root / "logs/web.log").write_text("\n".join(NGINX) + "\n")
    (root / "logs/old.log").write_text("\n".join(LOGFMT))
    (root / "logs/find.log").write_text(TRACE)
    (root / "manifest.yaml").write_text("app.log: {service: pay-api, format: json-lines}\nweb.log: {service: web-api, format: nginx}\nold.log: {service: old-api, format: logfmt}\nfind.log: {service: find-api, format: python-traceback}\n")
    (root / "git/pay.json").write_text(json.dumps(GIT))
    (root / "plans/plan.json").write_text(json.dumps(PLAN))
    (root / "applies.json").write_text(json.dumps(APPLIES))
    (root / "k8s/pod-status.json").write_text(json.dumps(PODS, indent=1))
    (root / "k8s/events.json").write_text(json.dumps(EVENTS, ensure_ascii=False))
    (root / "reviews/pool.md").write_text(REVIEW)
    return root


@pytest.fixture(scope="module")
def services(spark, corpus):
    return registry.read_services(spark, str(corpus / "services.yaml"))


@pytest.fixture(scope="module")
def drafts(spark, corpus, services):
    scanned = lines.scan_lines(spark, f"{corpus}/logs").withColumn("source_file", F.concat(F.lit("logs/"), F.element_at(F.split("source_file", "/"), -1)))
    manifest = registry.read_log_manifest(spark, str(corpus / "manifest.yaml"))
    found = formats.drafts(scanned, services, manifest)
    return spark.createDataFrame(found.collect(), found.schema)


def test_offsets_across_splits(spark, corpus):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        found = lines.scan_lines(spark, f"{corpus}/logs/app.log")
        assert spark.read.text(f"{corpus}/logs/app.log").rdd.getNumPartitions() > 1
        raw = (corpus / "logs/app.log").read_bytes()
        for r in found.collect():
            assert raw[r.source_offset :].startswith(r.raw.encode() + b"\n")
        assert found.count() == len(JSON_LINES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_drafts(drafts, services):
    ids = {r.name: r.id for r in services.collect()}
    rows = {(r.source_file[5:], r.source_offset): r for r in drafts.collect()}
    by = lambda f: [rows[k] for k in sorted(rows) if k[0] == f]
    app = by("app.log")
    assert [r.reason for r in app] == [None, None, None, "no_service_match", "no_timestamp", "unparseable", None]
    assert app[0].raw == JSON_LINES[0] and app[0].uid == python_uid("log", file="logs/app.log", offset=0, raw=JSON_LINES[0])
    assert (app[0].level, app[0].status_code, app[0].service_id, app[1].status_code) == ("error", 504, ids["pay-api"], 504)
    assert json.loads(app[0].attrs) == {"upstream": "db", "duration_ms": 30} and json.loads(app[2].attrs) == {"coercion_dropped": ["duration_ms"]}
    assert app[0].template_hash == app[1].template_hash
    web = by("web.log")
    assert [(r.reason, r.level, r.status_code) for r in web] == [(None, "error", 503), (None, "info", 200), ("no_timestamp", None, None), ("unparseable", None, None)]
    assert json.loads(web[0].attrs) == {"duration_ms": 250.0, "method": "GET", "path": "/a/b", "upstream_times": "0.1, 0.2"} and json.loads(web[1].attrs)["upstream_times"] == ""
    assert web[1].ts.replace(tzinfo=None) == datetime(2026, 8, 19, 14, 0, 10)
    old = by("old.log")
    assert [(r.reason, r.level, r.message) for r in old] == [(None, "warning", "pool low"), (None, "info", "no zone"), ("unparseable", None, None), ("unparseable", None, None)]
    assert json.loads(old[1].attrs) == {"coercion_dropped": ["duration_ms"]} and old[1].service_id == ids["old-api"]
    find = by("find.log")
    assert [r.reason for r in find] == ["unparseable", None, None, "ambiguous_service", "incomplete_traceback"]
    failed = json.loads(find[1].attrs)
    assert find[1].message == "ValueError: bad\nmore detail" and failed["exc_type"] == "ValueError" and failed["top_frame"] == {"file": "/lib/dep.py", "line": 9, "func": "<module>"}
    assert find[1].ts.replace(tzinfo=None) == datetime(2026, 8, 19, 14, 0, 0, 123000)
    assert records.parse_traceback(TRACE.split("\n")[11:14], True)["attrs"] == json.dumps({"logger": "app.index", "assembly": "incomplete", "stack": [{"file": "/srv/app.py", "line": 4, "func": "run"}], "top_frame": {"file": "/srv/app.py", "line": 4, "func": "run"}})


def test_git_terraform_k8s_reviews(spark, corpus, services):
    exports = git.read_exports(spark, f"{corpus}/git")
    first = git.commits(exports, services).where(F.col("sha") == "a" * 40).first()
    assert [(f.path, f.hunks_omitted) for f in first.files_changed] == [("a.py", "budget"), ("b.py", None), ("c.py", "webhook")] and (first.additions, first.deletions) == (6, 1)
    assert git.deployments(exports, services).count() == 2
    infra = {r.resource_name: r for r in terraform.infra_changes(terraform.read_plans(spark, f"{corpus}/plans"), terraform.read_applies(spark, str(corpus / "applies.json")), services).collect()}
    assert set(infra) == {"db.pool", "db.old"} and infra["db.old"].action == "replace" and infra["db.old"].service_id is None
    assert json.loads(infra["db.pool"].attribute_diff) == {"key": {"before": "<redacted>", "after": "<redacted>"}, "size": {"before": 5, "after": 2}, "tags": {"x": {"before": None, "after": "y"}}}
    assert infra["db.pool"].service_id == services.where("name = 'pay-api'").first().id and infra["db.pool"].provider == "p" and infra["db.old"].provider == "terraform"
    pods = k8s.pod_drafts(k8s.read_items(spark, f"{corpus}/k8s/pod-status.json"), services).collect()
    assert [(p.message, p.level) for p in pods] == [("OOMKilled: container c terminated (exit 137)", "error")]
    raw = (corpus / "k8s/events.json").read_bytes()
    events = {r.event_uid: r for r in k8s.event_drafts(k8s.read_items(spark, f"{corpus}/k8s/events.json"), services).collect()}
    assert (events["ev1"].level, events["ev1"].occurrence_count, events["ev2"].level, events["ev2"].occurrence_count) == ("warning", 7, "info", 1)
    for e in events.values():
        assert raw[e.source_offset :].startswith(e.raw.encode())
    review = postmortems.read_postmortems(spark, f"{corpus}/reviews", "fixture")
    r = review.first()
    assert (r.slug, r.title, r.services) == ("pool", "Pool", ["pay-api"]) and r.resolution_md.startswith("## Resolution")
    texts_ = [c.content for c in review.select(F.explode(postmortems.chunks_of(F.col("body_md"), F.lit(8191))).alias("c")).select("c.*").collect()]
    vectors = spark.createDataFrame([(t, [1.0, 0.0] if "pool" in t else [0.0, 1.0]) for t in texts_], "text string, vector array<float>")
    chunks = postmortems.chunk_table(review, vectors, 2)
    assert [(c.ordinal, c.kind) for c in chunks.orderBy("ordinal").collect()] == [(0, "section"), (1, "section"), (2, "resolution")]
    assert postmortems.changed_only(review, review).count() == 0
    assert chunked(spark, "## A\n\none two\n\nthree", 4) == [("section", "## A\n\none two"), ("section", "three")]
    for body, cap in (("## Resolution\na\n## Resolution\nb", 9), ("## Resolution\na b c", 2)):
        with pytest.raises(Exception, match="resolution"):
            chunked(spark, body, cap)


def chunked(spark, body, cap):
    found = spark.createDataFrame([(body, cap)], "body string, cap int").select(F.inline(postmortems.chunks_of(F.col("body"), F.col("cap")))).collect()
    return [tuple(c) for c in found]


def test_pod_names_of_many_suffixes(spark):
    from evidentry.operators.resolve import pod_candidates

    name = "web" + "".join(f"-{i}" for i in range(1, 13))
    found = spark.createDataFrame([(name,), ("web",)], "n string").select(pod_candidates(F.col("n")).alias("c")).collect()
    assert len(found[0].c) == 13 and found[0].c[-1] == "web" and found[1].c == ["web"]


def test_named_minutes_and_offsets_are_checked(spark):
    from evidentry.operators.rollups import checked_minutes

    pairs = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2026-01-01 00:01:00'), (1, TIMESTAMP '2026-01-01 00:01:00') AS t(service_id, bucket_start)")
    assert checked_minutes(pairs).count() == 1
    with pytest.raises(Exception, match="start of a minute"):
        checked_minutes(pairs.withColumn("bucket_start", F.expr("bucket_start + INTERVAL 1 SECOND"))).collect()
    with pytest.raises(ValueError, match="zone"):
        checked_minutes(pairs.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz")))
    with pytest.raises(Exception, match="null"):
        checked_minutes(pairs.withColumn("service_id", F.lit(None).cast("int"))).collect()
    assert S.checked_offsets(spark.range(3).withColumnRenamed("id", "source_offset")).count() == 3
    with pytest.raises(Exception, match="number of bytes"):
        S.checked_offsets(spark.range(-1, 1).withColumnRenamed("id", "source_offset")).collect()


def test_resolution_order(spark, services):
    rows = [(1, "pay-api", None, None, None, None), (2, "nobody", "pay", "pay", "org/pay", {"app": "pay"}), (3, None, "pay", None, None, None), (4, None, None, "web-12", "org/pay", None), (5, None, None, "zzz", "ORG/find.git", None), (6, None, None, None, "bad", {"app": "pay", "q": "r"}), (7, None, None, None, None, None), (8, "a b", None, None, None, None)]
    frame = spark.createDataFrame(rows, "id int, name string, log_key string, k8s_name string, repo string, infra_tags map<string,string>")
    ids = {r.id: r.name for r in services.collect()}
    found = {r.id: (ids.get(r.service_id), r.reason) for r in resolve(frame, services, "id").collect()}
    none = (None, "no_service_match")
    assert found == {1: ("pay-api", None), 2: none, 3: ("pay-api", None), 4: ("web-api", None), 5: ("find-api", None), 6: ("pay-api", None), 7: none, 8: none}
    twice = services.union(spark.createDataFrame([(9, "x-api", "org/WEB", ["pay"], [], {"zone": "b"}, "UTC")], services.schema))
    assert {(r.label, tuple(r.names)) for r in registry_conflicts(twice).collect()} == {("repo", ("web-api", "x-api")), ("log_key", ("pay-api", "x-api")), ("infra_tags", ("pay-api", "x-api"))}


@pytest.fixture()
def full(spark, corpus, services, drafts, tmp_path):
    evidence = S.EvidenceStore(spark, f"file://{tmp_path}/store")
    exports = git.read_exports(spark, f"{corpus}/git")
    infra = terraform.infra_changes(terraform.read_plans(spark, f"{corpus}/plans"), terraform.read_applies(spark, str(corpus / "applies.json")), services)
    reviews = postmortems.read_postmortems(spark, f"{corpus}/reviews", "fixture")
    vectors = reviews.select(F.explode(postmortems.chunks_of("body_md", F.lit(8191))).alias("c")).select(F.col("c.content").alias("text"), F.when(F.col("c.content").contains("the pool"), F.array(F.lit(0.8), F.lit(0.6))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("vector"))
    evidence.publish({"services": services, "commits": git.commits(exports, services), "deployments": git.deployments(exports, services), "infra_changes": infra, "postmortems": reviews, "chunks": postmortems.chunk_table(reviews, vectors, 2)})
    evidence.ingest(drafts)
    return evidence


def test_store_rules(spark, full, drafts):
    tables = lambda: {n: full.read(n) for n in ("log_events", "unresolved_events", "rollups")}
    first = provenance.replay_digest(tables())
    good, bad = drafts.where("reason IS NULL").count(), drafts.where("reason IS NOT NULL").count()
    assert full.ingest(drafts) == S.IngestReport(0, good + bad, 0, 0)
    assert provenance.replay_digest(tables()) == first
    with pytest.raises(S.EvidenceConflict, match="message"):
        full.ingest(drafts.where("reason IS NULL").limit(1).withColumn("message", F.lit("other")))
    with pytest.raises(S.EvidenceRegression):
        full.ingest(drafts.where("reason IS NULL").limit(1).withColumn("reason", F.lit("unparseable")))
    version = full.manifest()["version"]
    late = drafts.where("message = 'ok'").withColumn("uid", F.lit("f" * 32)).withColumn("ts", F.lit(datetime(2026, 8, 19, 14, 0, 0, 5)).cast("timestamp"))
    waiting = drafts.where("reason = 'no_service_match'").limit(1)
    moved = waiting.withColumn("reason", F.lit(None).cast("string")).withColumn("service_id", F.lit(1)).withColumn("level", F.lit("info")).withColumn("message", F.lit("x")).withColumn("template_hash", F.lit("0" * 32)).withColumn("attrs", F.lit("{}"))
    assert full.ingest(late.unionByName(moved)) == S.IngestReport(1, 0, 1, 0)
    assert full.manifest()["version"] == version + 1
    from evidentry.operators.rollups import rollup

    rebuilt = rollup(full.read("log_events"))
    assert sorted(map(tuple, rebuilt.collect())) == sorted(map(tuple, full.read("rollups").select(*rebuilt.columns).collect()))
    source = "logs/web.log"
    total = sum(len(x.encode()) for x in NGINX)
    full.ingest(drafts.where(F.col("source_file") == source), {source: total})
    assert full.cursor(source) == total
    with pytest.raises(S.CursorRegression):
        full.ingest(drafts, {source: total - 1})
    with pytest.raises(S.CursorGap):
        full.ingest(drafts, {source: 3 * total})


def test_three_queries(full):
    api = QueryInterface(full)
    found = api.get_error_telemetry("pay-api", "2026-08-19T14:00:00Z", "2026-08-19T14:04:30Z")
    assert found["effective_window"] == {"end": "2026-08-19T14:05:00Z", "snapped": True, "start": "2026-08-19T14:00:00Z"}
    assert [(s["status_class"], s["count"]) for s in found["status_breakdown"]] == [("5xx", 2), ("none", 1)] and found["baseline_sparse"] and found["sample_trace_ids"] == ["t1"]
    top = found["top_templates"][0]
    assert (top["count"], top["delta"], top["exemplar"]["upstream"], top["exemplar"]["duration_ms"]) == (2, 2, "db", 30.0)
    diff = api.get_incident_diff("pay-api", "2026-08-19T14:00:00Z", "2026-08-19T14:10:00Z")
    assert diff["counts"] == {"commits": 1, "deployments": 1, "infra_changes": 1} and len(diff["unattributed"]) == 1 and diff["other_services"] == []
    assert diff["focus"]["deployments"][0]["commit"]["sha"] == "b" * 40
    hits = api.search_similar_postmortems("pool exhausted", lambda text: [1.0, 0.0], service="pay-api")
    assert [(h["slug"], round(h["similarity"], 3)) for h in hits] == [("pool", 0.8)] and hits[0]["resolution_cite"].endswith("#2") and hits[0]["cite"].endswith("#1")
    for bad in (lambda: api.get_error_telemetry("nobody", "2026-08-19T14:00:00Z", "2026-08-19T14:10:00Z"), lambda: api.get_error_telemetry("pay-api", "2026-08-19 14:00", "x"), lambda: api.get_incident_diff("pay-api", "2026-08-19T14:00:00Z", "2026-08-19T14:10:00Z", True), lambda: api.search_similar_postmortems("x", lambda t: [1, 0], 0)):
        with pytest.raises(QueryError):
            bad()
    cites = set(provenance.harvest([found, diff, hits]))
    spark = full.spark
    captured = spark.createDataFrame([(c,) for c in cites], "cite string")
    claimed = spark.createDataFrame([(next(iter(cites)),), ("log:" + "0" * 32,)], "cite string")
    assert [(r.cite, r.well_formed) for r in provenance.unsupported(claimed, captured).collect()] == [("log:" + "0" * 32, True)]
    text = render.trace([{"kind": "tool_result", "tool": "diff", "result": diff}], [diff["focus"]["commits"][0]["cite"], "log:x"])
    assert text.endswith("commit:" + "a" * 40 + " <- 1\nlog:x <- MISSING FROM TRACE")
    assert render.markdown({"root_cause": {"text": "pool", "cites": ["log:a"]}, "confidence": 1}) == "## Root cause\n- pool [log:a]\n"
    assert render.packed_cites(["aa", "bb", "cc"], 5) == ("aa bb", 1)
    assert render.packed_cites(["aa", "b" * 9, "cc"], 5) == ("aa cc", 1)
    assert parse_time("2026-08-19T16:00:00+02:00") == datetime(2026, 8, 19, 14, tzinfo=UTC)


def test_snapshot_rules(spark, full):
    tables = {n: full.read(n) for n in full.tables if n != "identities"}
    assert snapshot_report(tables).collect() == []
    tables["rollups"] = tables["rollups"].union(tables["rollups"].limit(1)).withColumn("level", F.lit("loud"))
    tables["log_events"] = tables["log_events"].where("id <> 1")
    found = {(r.table, r.rule): r.n for r in snapshot_report(tables).collect()}
    assert found[("rollups", "unique")] == 1 and found[("rollups", "level")] == tables["rollups"].count()
    assert full.compact("log_events", 0) > 0 and full.compact("log_events") == 0


def test_deployments_and_snapshots(spark, full):
    stored = full.read("deployments")
    step = stored.where("status = 'in_progress'").withColumn("status", F.lit("success"))
    assert S.apply_deployments(stored, step).groupBy("status").count().collect()[0].asDict() == {"status": "success", "count": 2}
    with pytest.raises(S.IllegalTransition):
        S.apply_deployments(stored, stored.where("status = 'success'").withColumn("status", F.lit("failed")))
    rows = lambda *r: spark.createDataFrame(r, "event_uid string, occurrence_count long, uid string")
    gone, fresh = S.replaced_snapshots(rows(("a", 5, "u5"), ("b", 5, "v5"), ("c", 2, "w2")), rows(("a", 7, "u7"), ("a", 6, "u6"), ("b", 3, "v3"), ("c", 2, "w2"), ("d", 1, "x1")), "event_uid", "occurrence_count")
    assert sorted(r.uid for r in gone.collect()) == ["u5"] and sorted(r.uid for r in fresh.collect()) == ["u7", "x1"]
    unknown = spark.createDataFrame([(json.dumps({"repository": {"full_name": "Org/Pay"}, "number": 12, "pull_request": {"merged": True, "head": {"sha": "a" * 40}, "merge_commit_sha": "b" * 40}}),)], "value string")
    numbers = webhooks.pull_request_numbers(unknown)
    assert numbers.count() == 2
    with pytest.raises(Exception, match="another pull request"):
        webhooks.enrich_commits(full.read("commits"), full.read("services"), numbers).collect()
    only = webhooks.enrich_commits(full.read("commits"), full.read("services"), numbers.where(F.col("sha") == "a" * 40))
    assert {r.sha[0]: r.pr_number for r in only.collect()} == {"a": 12, "b": 4}


def test_pushes(spark):
    commit = {"id": "c" * 40, "timestamp": "2026-08-19T14:00:00Z", "message": "m", "author": {"name": "n"}, "added": ["x"], "modified": [], "removed": ["y"]}
    push = {"repository": {"full_name": "Org/Pay"}, "head_commit": {"id": "c" * 40}, "commits": [commit]}
    cases = [push, push | {"head_commit": {"id": "d" * 40}}, push | {"commits": [commit | {"removed": ["x"]}]}, {"commits": []}, push | {"commits": None}]
    found = webhooks.push_exports(spark.createDataFrame([(json.dumps(c),) for c in cases], "value string")).collect()
    assert [r.error for r in found] == [None, "truncated", "paths", "repository", "commits"]
    assert [(f.path, f.status, f.hunks) for f in found[0].commits[0].files_changed] == [("x", "added", None), ("y", "removed", None)]
    assert webhooks.signature_holds(b"body", "sha256=3ca8c0a68b02b4b87ed0f8b7b7e1ae9f0c9d9b5c", "k") is False
    import hashlib
    import hmac

    assert webhooks.signature_holds(b"body", "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest(), "k")


def test_streams(spark, full, drafts, tmp_path):
    fresh = S.EvidenceStore(spark, f"file://{tmp_path}/streamed")
    drafts.where("source_file = 'logs/app.log'").coalesce(1).write.parquet(f"{tmp_path}/in/one")
    landed = spark.readStream.schema(drafts.schema).parquet(f"{tmp_path}/in/*")
    stream_drafts(fresh, landed, f"{tmp_path}/check").awaitTermination()
    drafts.where("source_file <> 'logs/app.log'").coalesce(1).write.parquet(f"{tmp_path}/in/two")
    stream_drafts(fresh, landed, f"{tmp_path}/check").awaitTermination()
    both = lambda s: provenance.replay_digest({n: s.read(n) for n in ("log_events", "unresolved_events", "rollups")})
    assert both(fresh) == both(full)
    alert = {"service": "pay-api", "alert_name": "5xx", "fired_at": "2026-08-19T14:03:00+00:00", "window_start": "2026-08-19T14:00:00+00:00", "window_end": "2026-08-19T14:05:00+00:00", "payload": {}}
    (tmp_path / "alerts").mkdir()
    (tmp_path / "alerts/1.json").write_text("\n".join(json.dumps(a) for a in (alert, alert | {"fired_at": "2026-08-19T14:04:59+00:00"}, alert | {"dedup_key": "own"}, alert | {"dedup_key": "x", "event": {"data": {"id": "theirs"}}})))
    opened = []
    stream_alerts(full, f"{tmp_path}/alerts", f"{tmp_path}/check2", lambda rows: opened.extend(r.dedup_key for r in rows.collect())).awaitTermination()
    keys = sorted(r.dedup_key for r in full.read("incidents").collect())
    import hashlib

    assert keys == sorted(["own", "theirs", "fp:" + hashlib.sha256(b"pay-api|5xx|2026-08-19T14:00:00+00:00").hexdigest()[:32]]) == sorted(opened)


def test_scenarios():
    scenario = {"name": "a", "alert": {"service": "s", "dedup_key": "k", "payload": {}}, "expect": {"root_cause": "secret"}}
    assert registry.scenario_request(scenario) == {"service": "s", "payload": {}}
    assert registry.repeated_scenarios([scenario, scenario | {"name": "b"}]) == ["k"]
    with pytest.raises(ValueError):
        registry.service_rows([{"name": 3}])


def test_whole_corpus_twice(spark, corpus, tmp_path):
    import shutil

    root = tmp_path / "root"
    shutil.copytree(corpus, root)
    (root / "terraform").mkdir()
    shutil.move(root / "plans/plan.json", root / "terraform/plan-a.json")
    (root / "terraform/applies.json").write_text((root / "applies.json").read_text().replace("plan.json", "plan-a.json"))
    shutil.move(root / "reviews", root / "postmortems")
    shutil.move(root / "manifest.yaml", root / "logs/manifest.yaml")
    texts_ = [c for _, c in chunked(spark, REVIEW.split("---\n", 2)[2], 8191)]
    vectors = spark.createDataFrame([(t, [1.0, 0.0]) for t in texts_], "text string, vector array<float>")
    evidence = S.EvidenceStore(spark, f"file://{tmp_path}/store")
    digest = lambda: provenance.replay_digest({n: evidence.read(n) for n in evidence.tables})
    report = {r.reason: r.n for r in ingest_all(evidence, str(root), vectors, 2).collect()}
    assert report == {"ambiguous_service": 1, "incomplete_traceback": 1, "no_service_match": 1, "no_timestamp": 2, "unparseable": 5}
    first, events = digest(), evidence.read("log_events").count()
    ingest_all(evidence, str(root), vectors, 2)
    assert digest() == first
    newer = json.loads((root / "k8s/events.json").read_text())
    newer["items"][0] |= {"count": 9, "lastTimestamp": "2026-08-19T14:04:00Z"}
    newer["items"][1] |= {"eventTime": "2026-08-19T14:03:30Z"}
    (root / "k8s/events.json").write_text(json.dumps(newer))
    ingest_clusters(evidence, None, str(root / "k8s/events.json"))
    logs = evidence.read("log_events")
    counts = [json.loads(r.attrs)["occurrence_count"] for r in logs.where("attrs LIKE '%event_uid%'").collect()]
    assert sorted(counts) == [1, 9] and logs.count() == events
    from evidentry.operators.rollups import rollup

    rebuilt = rollup(logs)
    assert sorted(map(tuple, rebuilt.collect())) == sorted(map(tuple, evidence.read("rollups").select(*rebuilt.columns).collect()))


def test_runs(spark, full):
    run = runs.Run("r1")
    run.capture("diff", {"b": 1, "a": 2}, {"commits": [{"cite": "commit:x"}], "source_cites": ["log:y"]})
    summary = {"root_cause": {"text": "t" * 4000, "cites": ["commit:x"]}, "ruled_out": [{"text": "u", "cites": ["log:y"]}]}
    with pytest.raises(runs.UnsupportedCitation):
        run.checked({"root_cause": {"text": "t", "cites": ["log:z"]}})
    alert = spark.createDataFrame([("k", 1, None, None, None, "{}", None, "open")], full.tables["incidents"])
    full.publish({"incidents": alert})

    def failing(summary, run_id):
        raise RuntimeError("down")

    runs.store_run(full, "k", run.envelope(summary, failing), "done")
    found = runs.stored_run(full.read("incidents"), "r1")
    assert found["delivery"] == {"error": "down", "status": "failed"} and full.read("incidents").first().status == "done"
    with pytest.raises(LookupError):
        runs.stored_run(full.read("incidents"), "r2")
    blocks = runs.slack_blocks(summary, "r1")
    assert len(blocks) == 4 and all(len(b["text"]["text"]) <= runs.SECTION for b in blocks[:3]) and blocks[1]["text"]["text"].endswith("commit:x")
    many = runs.slack_blocks({"ruled_out": [{"text": "u", "cites": []}] * 60}, "r1")
    assert len(many) == runs.BLOCKS and many[-1]["elements"][0]["text"] == "run_id: r1 · 17 section(s) omitted"
    value = {"a": {"b": [{"c": 1}, {"c": 0}]}, "e": []}
    assert runs.resolve_path(value, "a.b[].c") == [1, 0] and runs.path_holds(value, "a.b[].c", "> 0") and not runs.path_holds(value, "a.b[].c", "== 0")
    assert runs.path_holds(value, "e", "is empty") and runs.path_holds(value, "a.b[].c", contains=[1, 0])
