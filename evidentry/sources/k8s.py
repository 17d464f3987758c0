"""Cluster snapshots: terminated containers and events, as log drafts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.functions.identity import k8s_event_uid, k8s_pod_uid
from evidentry.functions.texts import mask, template_hash
from evidentry.operators.resolve import resolve

POD = "metadata struct<uid:string,name:string>, status struct<containerStatuses:array<struct<name:string,restartCount:int,lastState:struct<terminated:struct<reason:string,exitCode:int,finishedAt:string>>>>>"
EVENT = "metadata struct<uid:string>, involvedObject struct<name:string>, type string, reason string, message string, count int, lastTimestamp string, eventTime string, series struct<lastObservedTime:string>"


def array_items(text: str) -> Iterator[tuple[int, str]]:
    """Each object of a JSON array, or of an object's items, with its byte offset and its own text."""
    stripped = text.lstrip()
    at = len(text) - len(stripped)
    if not stripped.startswith("["):
        outer = json.loads(text)
        if not isinstance(outer, dict) or not isinstance(outer.get("items"), list):
            raise ValueError("a snapshot is an array or an object with items")
        at = text.index("[", text.index('"items"'))
    decoder, at, seen, byte = json.JSONDecoder(), at + 1, 0, 0
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "]":
            return
        value, end = decoder.raw_decode(text, at)
        if not isinstance(value, dict):
            raise ValueError("a snapshot's items are objects")
        byte += len(text[seen:at].encode())
        seen = at
        yield byte, text[at:end]
        at = end


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_offset, raw): one row an item; each file is one JSON document, decoded by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items = list(array_items(text))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(items), pa.string()), pa.array([i[0] for i in items], pa.int64()), pa.array([i[1] for i in items], pa.string())], ["source_file", "source_offset", "raw"])

    whole = spark.read.text(path, wholetext=True).select(F.concat(F.lit("logs/"), F.col("_metadata.file_name")).alias("source_file"), "value")
    return whole.mapInArrow(run, "source_file string, source_offset long, raw string")


def _needed(column: Column, name: str) -> Column:
    return F.coalesce(column, F.raise_error(F.lit(f"missing {name}")).cast("string"))


def _time(column: Column, name: str, needed: Column | bool = True) -> Column:
    """A time with a zone. Raises where one is ``needed`` and missing: the planner may evaluate rows that a filter drops later."""
    good = column.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\z")
    needed = F.lit(needed) if isinstance(needed, bool) else needed
    return F.when(good, F.to_timestamp(column)).when(needed, F.raise_error(F.lit(f"{name} needs a time with a zone")).cast("timestamp"))


def _drafts(rows: DataFrame, services: DataFrame) -> DataFrame:
    """Items of pods that no service runs are left out."""
    found = resolve(rows, services, "uid").where("reason IS NULL")
    none = F.lit(None)
    return found.select(
        "uid", "ts", "service_id", "level", none.cast("int").alias("status_code"), none.cast("string").alias("trace_id"), "message",
        template_hash(mask("message")).alias("template_hash"), "raw", "attrs", "source_file", "source_offset", "event_uid", "occurrence_count", none.cast("string").alias("reason"),
    )


def pod_drafts(items: DataFrame, services: DataFrame) -> DataFrame:
    """One error for each terminated container state."""
    pods = items.withColumn("i", F.from_json("raw", POD)).select("source_file", "source_offset", "raw", "i.metadata", F.explode("i.status.containerStatuses").alias("c")).where("c.lastState.terminated IS NOT NULL")
    t = F.col("c.lastState.terminated")
    finished = _time(t["finishedAt"], "finishedAt", t.isNotNull())
    rows = pods.select(
        k8s_pod_uid(_needed(F.col("metadata.uid"), "uid"), F.col("c.name"), F.col("c.restartCount"), finished).alias("uid"),
        _needed(F.col("metadata.name"), "name").alias("k8s_name"), finished.alias("ts"), F.lit("error").alias("level"),
        F.concat(t["reason"], F.lit(": container "), F.col("c.name"), F.lit(" terminated (exit "), t["exitCode"].cast("string"), F.lit(")")).alias("message"), "raw",
        F.to_json(F.struct(t["exitCode"].alias("exit_code"), F.lit("PodStatus").alias("kind"), t["reason"].alias("reason"), F.col("c.restartCount").alias("restart_count"), F.lit("k8s").alias("source"))).alias("attrs"),
        "source_file", "source_offset", F.lit(None).cast("string").alias("event_uid"), F.lit(None).cast("long").alias("occurrence_count"),
    )
    return _drafts(rows, services)


def event_drafts(items: DataFrame, services: DataFrame) -> DataFrame:
    """One draft an event; its count is kept on the row, 1 where it has none."""
    e = items.withColumn("i", F.from_json("raw", EVENT)).select("source_file", "source_offset", "raw", "i.*")
    ts = _time(F.coalesce("lastTimestamp", "eventTime", "series.lastObservedTime"), "event")
    count = F.coalesce("count", F.lit(1))
    rows = e.select(
        k8s_event_uid(_needed(F.col("metadata.uid"), "uid"), count, ts).alias("uid"), _needed(F.col("involvedObject.name"), "name").alias("k8s_name"), ts.alias("ts"),
        F.when(F.col("type") == "Warning", "warning").otherwise("info").alias("level"), F.concat(_needed(F.col("reason"), "reason"), F.lit(": "), _needed(F.col("message"), "message")).alias("message"), "raw",
        F.to_json(F.struct(F.col("metadata.uid").alias("event_uid"), F.lit("Event").alias("kind"), count.alias("occurrence_count"), "reason", F.lit("k8s").alias("source"))).alias("attrs"),
        "source_file", "source_offset", F.col("metadata.uid").alias("event_uid"), count.cast("long").alias("occurrence_count"),
    )
    return _drafts(rows, services)
