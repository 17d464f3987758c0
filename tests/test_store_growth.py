"""What a batch reads does not grow with the history, and a snapshot replaces in one publication."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentry.operators import store as S
from evidentry.operators.rollups import rollup

DRAFT = "uid string, ts timestamp, service_id int, level string, status_code int, trace_id string, message string, template_hash string, raw string, attrs string, source_file string, source_offset long, reason string"
START = datetime(2026, 1, 1, 12)


def drafts(spark, rows):
    """Rows (uid, day, message, reason)."""
    out = []
    for uid, day, message, reason in rows:
        ts = None if day is None else START + timedelta(days=day)
        out.append((uid, ts, None if reason else 1, None if reason else "info", None, None, None if reason else message, None if reason else "0" * 32, message, None if reason else "{}", "logs/a.log", sum(map(ord, uid)), reason))
    return spark.createDataFrame(out, DRAFT)


@pytest.fixture
def evidence(spark, tmp_path):
    return S.EvidenceStore(spark, f"file://{tmp_path}/store")


def folders(df):
    return sorted({f.rsplit("/on=", 1)[1].split("/")[0] for f in df.inputFiles()})


def test_a_batch_reads_the_identities_of_its_own_days(spark, evidence, monkeypatch):
    read = []
    plain = S.EvidenceStore.read
    monkeypatch.setattr(S.EvidenceStore, "read", lambda self, name, days=None: read.append((name, days)) or plain(self, name, days))
    for day in range(0, 30, 3):
        rows = [(f"u{day}-{k}", day, f"m{k}", None) for k in range(3)]
        read.clear()
        assert evidence.ingest(drafts(spark, rows)) == S.IngestReport(3, 0, 0, 0)
        assert all(days is not None for name, days in read if name in ("identities", "log_events", "rollups"))
        assert len(folders(evidence._known([str((START + timedelta(days=day)).date())], 0))) == 1
    again = drafts(spark, [("u15-1", 15, "m1", None), ("new", 15, "m", None), ("open", 15, "x", "no_service_match")])
    assert evidence.ingest(again) == S.IngestReport(1, 1, 0, 1)
    assert evidence.ingest(drafts(spark, [("open", 15, "x", None)])) == S.IngestReport(0, 0, 1, 0)
    assert sorted(r.id for r in evidence.read("log_events").select("id").collect()) == list(range(1, 33))
    with pytest.raises(S.EvidenceConflict, match="message"):
        evidence.ingest(drafts(spark, [("u15-1", 15, "other", None)]))
    with pytest.raises(S.EvidenceConflict, match="ts"):  # the zone was set anew: a day beside its own
        evidence.ingest(drafts(spark, [("u15-1", 16, "m1", None)]))
    with pytest.raises(S.EvidenceRegression):  # without a time all days are asked
        evidence.ingest(drafts(spark, [("u27-1", None, "m1", "no_timestamp")]))


def snapshots(spark, rows):
    """Rows (event, count, uid, day, reason)."""
    found = drafts(spark, [(uid, day, f"seen {n}", reason) for _, n, uid, day, reason in rows])
    named = spark.createDataFrame([(uid, e, n) for e, n, uid, _, _ in rows], "of string, event_uid string, occurrence_count long")
    return found.join(named, F.col("uid") == F.col("of")).drop("of")


def test_newer_snapshots_replace_older_ones_at_once(spark, evidence, monkeypatch):
    evidence.ingest(drafts(spark, [("plain", 0, "m", None), ("far", 9, "m", None)]))
    evidence.ingest_snapshots(snapshots(spark, [("a", 5, "a5", 0, None), ("b", 2, "b2", 0, None), ("c", 1, "c1", 0, "no_service_match")]))
    version = evidence.manifest()["version"]
    read = []
    plain = S.EvidenceStore.read
    monkeypatch.setattr(S.EvidenceStore, "read", lambda self, name, days=None: read.append((name, days)) or plain(self, name, days))
    report = evidence.ingest_snapshots(snapshots(spark, [("a", 7, "a7", 2, None), ("b", 1, "b1", 2, None), ("c", 1, "c1", 0, None), ("d", 1, "d1", 2, None)]))
    assert all(days is not None for name, days in read if name == "log_events")
    assert evidence.manifest()["version"] == version + 1
    assert report == S.IngestReport(2, 0, 1, 0)
    events = evidence.read("log_events")
    assert {r.uid for r in events.collect()} == {"plain", "far", "a7", "b2", "c1", "d1"}
    rebuilt = rollup(events)
    assert sorted(map(tuple, rebuilt.collect())) == sorted(map(tuple, evidence.read("rollups").select(*rebuilt.columns).collect()))
    assert {(r.event_uid, r.occurrence_count) for r in evidence.read("cluster_events").collect()} == {("a", 7), ("b", 2), ("c", 1), ("d", 1)}
    assert evidence.ingest_snapshots(snapshots(spark, [("a", 7, "a7", 2, None)])) == S.IngestReport(0, 0, 0, 0)
