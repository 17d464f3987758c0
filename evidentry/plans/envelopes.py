"""The three query interfaces: checked arguments in, ordered JSON-ready responses out.

Each response is bounded by a window and top-n, and is built on the driver from the plans in
``evidentry.operators``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evidentry.functions import citations
from evidentry.functions.jsondiff import sorted_json
from evidentry.functions.times import Window, resolve_window
from evidentry.operators import changes, similar, telemetry
from evidentry.operators.store import EvidenceStore

RFC3339 = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})")


class QueryError(ValueError):
    """An argument that no query can be made of."""


def parse_time(value: str) -> datetime:
    """An RFC 3339 time with a zone."""
    if not isinstance(value, str) or not RFC3339.fullmatch(value):
        raise QueryError("times are RFC 3339 with a zone")
    return datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(UTC)


def _whole(value: Any, name: str, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise QueryError(f"{name} must be a whole number of {least} or more")
    return value


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, datetime):
        return (value if value.tzinfo else value.replace(tzinfo=UTC)).astimezone(UTC).isoformat().replace("+00:00", "Z")
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _rows(frame: DataFrame) -> list[dict]:
    return [_plain(r) for r in frame.collect()]


def _window(start: str, end: str) -> Window:
    try:
        return resolve_window(parse_time(start), parse_time(end))
    except QueryError:
        raise
    except ValueError as error:
        raise QueryError(str(error)) from error


def _shown(window: Window) -> dict:
    return {"start": _plain(window.start), "end": _plain(window.end), "snapped": window.snapped}


class QueryInterface:
    """The three queries over a store's current snapshot."""

    def __init__(self, store: EvidenceStore):
        self.store = store

    def _service(self, name: str) -> int:
        found = self.store.read("services").where(F.col("name") == name).select("id").first()
        if found is None:
            raise QueryError(f"unknown service: {name}")
        return found.id

    def get_error_telemetry(self, service: str, window_start: str, window_end: str, top_n: int = 10, baseline_sparse_threshold: int = 50) -> dict:
        window = _window(window_start, window_end)
        _whole(top_n, "top_n", 1)
        number = self._service(service)
        both = Window(window.before().start, window.end)
        days = both.dates()
        events = self.store.read("log_events", days)
        rows = telemetry.rollups_in(self.store.read("rollups", days), self.store.read("services"), service, window)
        # Exemplars lie within their rollups' minutes, so the same range bounds the scan of events.
        rows = telemetry.with_exemplars(rows, events.where((F.col("service_id") == number) & both.holds(F.col("ts"))))
        found = telemetry.anomalies(rows).join(telemetry.occurrence_counts(events, number, window), ["template_hash", "level"], "left")
        ranked = telemetry.top_templates(found, top_n).orderBy(F.desc("is_error"), "rank").drop("is_error", "rank")
        return sorted_json(
            {
                "effective_window": _shown(window),
                "baseline_window": _shown(window.before()),
                "baseline_sparse": telemetry.baseline_sparse(rows, baseline_sparse_threshold).first().baseline_sparse,
                "series": _rows(telemetry.series(rows).orderBy("bucket_start", "status_class")),
                "top_templates": _rows(ranked),
                "status_breakdown": _rows(telemetry.status_breakdown(rows).orderBy("status_class")),
                "sample_trace_ids": [r.trace_id for r in telemetry.sample_traces(rows).orderBy("ts", "uid").collect()],
            }
        )

    def get_incident_diff(self, service: str, window_start: str, window_end: str, lookback_minutes: int = 60, include_other_services: bool = True) -> dict:
        window = _window(window_start, window_end).widened(_whole(lookback_minutes, "lookback_minutes", 0))
        number = self._service(service)
        named = self.store.read("services").select(F.col("id").alias("service_id"), F.col("name").alias("service"))
        commits, deployments, infra = (self.store.read(n) for n in ("commits", "deployments", "infra_changes"))
        if not include_other_services:
            wanted = F.col("service_id") == number
            commits_in, deployments, infra = commits.where(wanted), deployments.where(wanted), infra.where(wanted | F.col("service_id").isNull())
        else:
            commits_in = commits
        reference = changes.commit_reference()
        shipped = deployments.where(window.holds(F.col("started_at"))).join(commits.withColumnRenamed("sha", "commit_sha").withColumn("sha", F.col("commit_sha")).drop("service_id"), "commit_sha")
        deploy_rows = shipped.join(named, "service_id").select("service", F.struct(citations.deploy(F.col("uid")).alias("cite"), "environment", "started_at", "status", reference.alias("commit")).alias("x")).orderBy(F.desc("x.started_at"), "x.cite").collect()
        commit_rows = changes.standalone_commits(commits_in, deployments, window).join(named, "service_id").select("service", reference.alias("x")).orderBy(F.desc("x.committed_at"), "x.sha").collect()
        change = F.struct(citations.infra(F.col("uid")).alias("cite"), "provider", "resource_type", "resource_name", "action", "attribute_diff", "applied_at", "service")
        infra_rows = changes.infra_in(infra, window).join(named, "service_id", "left").select("service", change.alias("x")).orderBy(F.desc("x.applied_at"), "x.cite").collect()
        blocks: dict[str | None, dict] = {}
        for key, found in (("commits", commit_rows), ("deployments", deploy_rows), ("infra_changes", infra_rows)):
            for r in found:
                blocks.setdefault(r.service, {"service": r.service, "commits": [], "deployments": [], "infra_changes": []})[key].append(_plain(r.x))
        focus = blocks.pop(service, {"service": service, "commits": [], "deployments": [], "infra_changes": []})
        loose = blocks.pop(None, {"infra_changes": []})["infra_changes"]
        return sorted_json(
            {
                "window": _shown(window),
                "focus": focus,
                "other_services": [blocks[s] for s in sorted(blocks)] if include_other_services else [],
                "unattributed": loose,
                "counts": {k: len(focus[k]) for k in ("commits", "deployments", "infra_changes")},
            }
        )

    def search_similar_postmortems(self, error_signature: str, embed: Callable[[str], Sequence[float]], k: int = 5, service: str | None = None) -> list[dict]:
        """``embed`` gives the signature's vector: a fixture table or any provider."""
        _whole(k, "k", 1)
        if service is not None:
            self._service(service)
        return sorted_json(_rows(similar.search(self.store.read("postmortems"), self.store.read("chunks"), embed(error_signature), k, service)))
