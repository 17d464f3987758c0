"""A streaming front end: files that land in a folder become snapshots of the store, batch by batch.

Each micro-batch goes through the same parsers and the same conflict rules as a batch run. Late
events are never dropped: their minutes are rebuilt, so there is no event-time watermark.
Repeating a batch after a failure changes nothing, as its rows are then duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidentry.operators.store import EvidenceStore, insert_new
from evidentry.sources.webhooks import alerts, new_incidents


def stream_drafts(store: EvidenceStore, drafts: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """``drafts`` is a streaming table of log drafts."""

    def take(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            store.ingest(batch)

    return drafts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_alerts(store: EvidenceStore, folder: str, checkpoint: str, on_new: Callable[[DataFrame], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """JSON alerts, one a line; the first alert of a key opens an incident, and only that one is passed on."""
    raw = store.spark.readStream.text(folder)

    def take(batch: DataFrame, number: int) -> None:
        stored, services = store.read("incidents"), store.read("services")
        named = services.selectExpr("name AS service", "id AS service_id")
        fresh = new_incidents(alerts(batch), stored).join(named, "service", "left").selectExpr(
            "dedup_key", "service_id", "opened_at", "window_start", "window_end", "alert_payload", "CAST(NULL AS STRING) AS summary_json", "status"
        )
        if fresh.limit(1).count():
            store.publish({"incidents": insert_new(stored, fresh, "dedup_key")})
            if on_new:
                on_new(fresh)

    return raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
