"""Content-derived identities: the first 32 hex digits of the SHA-256 of canonical JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentry.functions.times import wire

VERSION = 1


def json_string(text: Column) -> Column:
    """A JSON string literal with non-ASCII characters kept and control characters as \\u00xx in lower case."""
    plain = usual = out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    common = (9, 10, 13)  # tabs and line ends; the other control characters are asked for only where there are some
    for code in (*common, *(c for c in range(32) if c not in common)):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
        usual = out if code == common[-1] else usual
    body = F.when(~text.rlike("[\\x00-\\x1f]"), plain).when(~text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), usual).otherwise(out)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def uid(kind: str, fields: dict[str, Column]) -> Column:
    """``fields`` are already JSON values; keys are sorted among kind and v."""
    parts = fields | {"kind": F.lit(json.dumps(kind)), "v": F.lit(str(VERSION))}
    pieces: list[Column] = []
    for i, (key, value) in enumerate(sorted(parts.items())):
        pieces += [F.lit(("," if i else "{") + json.dumps(key) + ":"), value]
    return F.substring(F.sha2(F.concat(*pieces, F.lit("}")), 256), 1, 32)


def log_uid(file: Column, offset: Column, raw: Column) -> Column:
    return uid("log", {"file": json_string(file), "offset": json_number(offset), "raw": json_string(raw)})


def deployment_uid(sha: Column, environment: Column, started_at: Column) -> Column:
    return uid("deploy", {"commit_sha": json_string(sha), "environment": json_string(environment), "started_at": json_string(wire(started_at))})


def infra_uid(apply_id: Column, resource_type: Column, resource_name: Column, action: Column, provider: Column) -> Column:
    fields = {"apply_id": apply_id, "resource_type": resource_type, "resource_name": resource_name, "action": action, "provider": provider}
    return uid("infra", {k: json_string(v) for k, v in fields.items()})


def k8s_event_uid(event_uid: Column, count: Column, last: Column) -> Column:
    return uid("k8s-event", {"event_uid": json_string(event_uid), "count": json_number(count), "last_timestamp": json_string(wire(last))})


def k8s_pod_uid(pod_uid: Column, container: Column, restarts: Column, finished: Column) -> Column:
    return uid("k8s-pod", {"pod_uid": json_string(pod_uid), "container": json_string(container), "restart_count": json_number(restarts), "finished_at": json_string(wire(finished))})


def python_uid(kind: str, **fields) -> str:
    """The same for values on the driver; for tests and small inputs."""
    body = json.dumps({"v": VERSION, "kind": kind, **fields}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(body.encode()).hexdigest()[:32]
