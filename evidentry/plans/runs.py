"""Stored investigation runs: what was captured, what the summary cites, how it is delivered."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.functions.jsondiff import sorted_json
from evidentry.operators.provenance import harvest
from evidentry.operators.store import EvidenceStore
from evidentry.plans.render import packed_cites

SECTION, BLOCKS = 2900, 45


class UnsupportedCitation(ValueError):
    """A summary cites what no captured result had."""


class TraceSink(Protocol):
    def emit(self, event: Mapping[str, Any]) -> None: ...


Delivery = Callable[[Mapping[str, Any], str], Mapping[str, Any]]


@dataclass
class Run:
    """A run's trace; every result's citations are captured before a summary may use them."""

    run_id: str
    sinks: list[TraceSink] = field(default_factory=list)
    trace: list[dict[str, Any]] = field(default_factory=list)
    captured: set[str] = field(default_factory=set)

    def capture(self, tool: str, arguments: Mapping[str, Any], result: Any) -> None:
        self.captured |= set(harvest(result))
        event = {"kind": "tool_result", "tool": tool, "arguments": sorted_json(dict(arguments)), "result": sorted_json(result), "at": datetime.now(UTC).isoformat()}
        self.trace.append(event)
        for sink in self.sinks:
            sink.emit(event)

    def checked(self, summary: Mapping[str, Any]) -> Mapping[str, Any]:
        """The summary, if all it cites was captured."""
        missing = sorted(summary_cites(summary) - self.captured)
        if missing:
            raise UnsupportedCitation(", ".join(missing))
        return summary

    def envelope(self, summary: Mapping[str, Any], delivery: Delivery | None = None) -> str:
        """The JSON that is stored; a delivery that fails becomes part of it and doesn't undo the run."""
        outcome: Mapping[str, Any] = {"status": "skipped"}
        if delivery:
            try:
                outcome = delivery(summary, self.run_id)
            except Exception as error:  # what a delivery raises is data
                outcome = {"status": "failed", "error": str(error)}
        return json.dumps(sorted_json({"run_id": self.run_id, "summary": self.checked(summary), "trace": self.trace, "delivery": dict(outcome)}), ensure_ascii=False)


def summary_cites(value: Any) -> set[str]:
    """All citations under ``cites`` keys, at any depth."""
    if isinstance(value, Mapping):
        own = set(value["cites"]) if isinstance(value.get("cites"), list) else set()
        return own.union(*(summary_cites(v) for v in value.values()))
    return set().union(*map(summary_cites, value)) if isinstance(value, list) else set()


def store_run(store: EvidenceStore, dedup_key: str, envelope: str, status: str) -> int:
    """Sets the incident's summary and status in a new snapshot."""
    rows = store.read("incidents")
    own = F.col("dedup_key") == dedup_key
    return store.publish({"incidents": rows.withColumn("summary_json", F.when(own, F.lit(envelope)).otherwise(F.col("summary_json"))).withColumn("status", F.when(own, F.lit(status)).otherwise(F.col("status")))})


def stored_run(incidents: DataFrame, run_id: str) -> dict[str, Any]:
    """The one stored run of that id; none or two raise."""
    found = incidents.where(F.get_json_object("summary_json", "$.run_id") == run_id).select("summary_json").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} stored run {run_id}")
    run = json.loads(found[0].summary_json)
    missing = summary_cites(run["summary"]) - set(harvest([e.get("result", {}) for e in run["trace"]]))
    if missing:
        raise UnsupportedCitation(", ".join(sorted(missing)))
    return run


def slack_blocks(summary: Mapping[str, Any], run_id: str) -> list[dict[str, Any]]:
    """Message blocks: claims are shortened to a section's size, citations are only ever left out whole, and counted.

    A message has ``BLOCKS`` blocks at most; the last one says how many claims had no room.
    """
    blocks: list[dict[str, Any]] = [{"type": "header", "text": {"type": "plain_text", "text": f"Run {run_id}"}}]
    for name, value in summary.items():
        for claim in value if isinstance(value, list) else [value]:
            if isinstance(claim, Mapping) and "text" in claim:
                cites, left = packed_cites(list(claim.get("cites", [])), SECTION // 2)
                tail = "\n" + cites + (f" (+{left} more)" if left else "")
                room = SECTION - len(tail) - len(name) - 5
                text = claim["text"] if len(claim["text"]) <= room else claim["text"][: room - 1] + "…"
                blocks.append({"type": "section", "text": {"type": "mrkdwn", "text": f"*{name}* {text}{tail}"}})
    left = max(0, len(blocks) - (BLOCKS - 1))
    footer = f"run_id: {run_id}" + (f" · {left} section(s) omitted" if left else "")
    return [*blocks[: BLOCKS - 1], {"type": "context", "elements": [{"type": "mrkdwn", "text": footer}]}]


def resolve_path(value: Any, path: str) -> list[Any]:
    """The values at a dotted path; ``[]`` after a name goes into each item of a list."""
    found = [value]
    for step in path.split("."):
        name, each = step.removesuffix("[]"), step.endswith("[]")
        found = [v[name] for v in found if isinstance(v, Mapping) and name in v]
        if each:
            found = [x for v in found if isinstance(v, list) for x in v]
    return found


def path_holds(value: Any, path: str, predicate: str | None = None, contains: list[Any] | None = None) -> bool:
    """Whether some value there is ``> 0``, all are ``== 0``, nothing is there (``is empty``), or all of ``contains`` are."""
    found = resolve_path(value, path)
    if contains is not None:
        return all(any(c == v or isinstance(v, list | str) and c in v for v in found) for c in contains)
    if predicate == "is empty":
        return all(v in (None, [], {}, "") for v in found)
    if predicate == "== 0":
        return bool(found) and all(v == 0 for v in found)
    if predicate == "> 0":
        return any(v > 0 for v in found)
    raise ValueError(f"unknown predicate: {predicate}")
