"""One pass over a corpus folder, in a fixed order: services, exports, logs, plans, clusters, reviews.

The order decides the sequence numbers of log events and with them which event stands for a
rollup. Running it again on the same files changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.operators.store import EvidenceConflict, EvidenceStore, IngestReport, apply_deployments, split_batch, unresolved_report
from evidentry.schemas import INFRA_CONTENT
from evidentry.session import materialize
from evidentry.sources import formats, git, k8s, lines, postmortems, registry, terraform


def log_lines(store: EvidenceStore, path: str, prefix: str = "logs/") -> DataFrame:
    return lines.scan_lines(store.spark, path).withColumn("source_file", F.concat(F.lit(prefix), F.element_at(F.split("source_file", "/"), -1)))


def ingest_exports(store: EvidenceStore, path: str) -> int:
    services, exports = store.read("services"), git.read_exports(store.spark, path)
    fresh = git.commits(exports, services).dropDuplicates(["sha"]).join(store.read("commits").select("sha"), "sha", "left_anti")
    return store.publish(added={"commits": fresh}, changed={"deployments": apply_deployments(store.read("deployments"), git.deployments(exports, services))})


def ingest_logs(store: EvidenceStore, path: str, manifest: str | None = None) -> IngestReport:
    declared = registry.read_log_manifest(store.spark, manifest) if manifest else None
    return store.ingest(formats.drafts(log_lines(store, path), store.read("services"), declared))


def ingest_plans(store: EvidenceStore, plans: str, applies: str) -> int:
    """New changes are added; one that is known with other values raises."""
    found = terraform.infra_changes(terraform.read_plans(store.spark, plans), terraform.read_applies(store.spark, applies), store.read("services"))
    stored = store.read("infra_changes")
    batch = materialize(split_batch(found, stored, "uid", INFRA_CONTENT), "infra")
    clash = batch.where("outcome = 'conflict'").limit(5).collect()
    if clash:
        raise EvidenceConflict("; ".join(f"{r.uid} ({', '.join(r.differs)})" for r in clash))
    return store.publish(added={"infra_changes": batch.where("outcome = 'inserted'").dropDuplicates(["uid"])})


def ingest_clusters(store: EvidenceStore, pods: str | None, events: str | None) -> None:
    """Pods are added as they are; an event's newer snapshot takes the place of its older one, and both minutes are rebuilt."""
    services = store.read("services")
    if pods:
        store.ingest(k8s.pod_drafts(k8s.read_items(store.spark, pods), services).drop("event_uid", "occurrence_count"))
    if events:
        store.ingest_snapshots(k8s.event_drafts(k8s.read_items(store.spark, events), services))


def ingest_reviews(store: EvidenceStore, path: str, vectors: DataFrame, size: int, fingerprint: str, cap: int = 8191) -> int:
    """Only reviews that changed, or whose embedding model did, get new chunks. ``vectors`` has (text, vector)."""
    stored, chunks = store.read("postmortems"), store.read("chunks")
    fresh = materialize(postmortems.changed_only(postmortems.read_postmortems(store.spark, path, fingerprint), stored), "reviews")
    kept = stored.join(fresh.select("slug"), "slug", "left_anti").select(*stored.columns)
    return store.publish({"postmortems": kept.unionByName(fresh.select(*stored.columns)), "chunks": postmortems.replace_chunks(chunks, postmortems.chunk_table(fresh, vectors, size, cap))})


def ingest_all(store: EvidenceStore, root: str, vectors: DataFrame | None = None, size: int = 1024, fingerprint: str = "fixture", cap: int = 8191) -> DataFrame:
    """The whole corpus in order; gives the report of unresolved lines. Without vectors reviews are left out, and the report says so."""
    store.publish({"services": registry.upsert_services(store.read("services"), registry.read_services(store.spark, f"{root}/services.yaml"))})
    ingest_exports(store, f"{root}/git")
    ingest_logs(store, f"{root}/logs/*.log", f"{root}/logs/manifest.yaml")
    ingest_plans(store, f"{root}/terraform/plan-*.json", f"{root}/terraform/applies.json")
    ingest_clusters(store, f"{root}/k8s/pod-status.json", f"{root}/k8s/events.json")
    report = unresolved_report(store.read("unresolved_events"))
    if vectors is None:
        return report.unionByName(store.spark.createDataFrame([("reviews skipped: no vectors", 0)], "reason string, n long"))
    ingest_reviews(store, f"{root}/postmortems/*.md", vectors, size, fingerprint, cap)
    return report
