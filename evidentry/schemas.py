"""Explicit schemas of the evidence tables."""

from __future__ import annotations

SERVICES = "id int, name string, repo string, log_keys array<string>, k8s_names array<string>, infra_tags map<string,string>, log_timezone string"
FILE_CHANGE = "struct<path:string,status:string,additions:int,deletions:int,hunks:string,hunks_omitted:string>"
COMMITS = f"sha string, service_id int, authored_at timestamp, committed_at timestamp, message string, author string, pr_number int, files_changed array<{FILE_CHANGE}>, additions int, deletions int"
DEPLOYMENTS = "uid string, service_id int, commit_sha string, environment string, started_at timestamp, finished_at timestamp, status string"
INFRA_CHANGES = "uid string, provider string, resource_type string, resource_name string, resource_id string, action string, attribute_diff string, applied_at timestamp, apply_id string, source_ref string, service_id int"
LOG_EVENTS = "id long, uid string, ts timestamp, service_id int, level string, status_code int, trace_id string, message string, template_hash string, raw string, attrs string, source_file string, source_offset long"
UNRESOLVED_EVENTS = "uid string, ts timestamp, raw string, reason string, source_file string, source_offset long"
ROLLUPS = "service_id int, bucket_start timestamp, status_class string, level string, template_hash string, count long, first_seen timestamp, last_seen timestamp, exemplar_id long"
POSTMORTEMS = "slug string, title string, occurred_at timestamp, services array<string>, body_md string, resolution_md string, content_sha string, model_fingerprint string"
CHUNKS = "slug string, ordinal int, kind string, content string, embedding array<float>"
INCIDENTS = "dedup_key string, service_id int, opened_at timestamp, window_start timestamp, window_end timestamp, alert_payload string, summary_json string, status string"
IDENTITIES = "uid string, content long, id long, on_date date"
#: The newest snapshot of each cluster event that is a log event, so that a newer one finds the row it takes the place of.
CLUSTER_EVENTS = "event_uid string, occurrence_count long, uid string, service_id int, ts timestamp"
WATERMARKS = "source string, last_cursor string, updated_at timestamp"

#: Columns that two versions of one identity must share.
LOG_CONTENT = ("ts", "service_id", "level", "status_code", "trace_id", "message", "template_hash", "raw", "attrs", "source_file", "source_offset")
UNRESOLVED_CONTENT = ("ts", "raw", "reason", "source_file", "source_offset")
INFRA_CONTENT = ("provider", "resource_type", "resource_name", "action", "attribute_diff", "applied_at", "apply_id", "service_id")

#: Enumerations of the data model. 1xx and incomplete_traceback are accepted, as parsing yields them.
LEVELS = ("debug", "info", "warning", "error", "fatal")
STATUS_CLASSES = ("1xx", "2xx", "3xx", "4xx", "5xx", "none")
REASONS = ("unparseable", "no_timestamp", "no_service_match", "ambiguous_service", "incomplete_traceback")
DEPLOY_STATUSES = ("in_progress", "success", "failed", "rolled_back")
INFRA_ACTIONS = ("create", "update", "delete", "replace")
CHUNK_KINDS = ("section", "resolution")
