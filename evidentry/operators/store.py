"""The evidence store: immutable rows, exact conflicts, and snapshots published at once.

Tables are folders of Parquet; a snapshot is a manifest that names each table's folders, with
the sources' cursors. A batch is checked against the current snapshot, written to new folders
beside the old ones, and becomes visible when its manifest is renamed into place. A failed batch leaves
nothing behind that a reader would see. One writer at a time, as a streaming query's
``foreachBatch`` is; what the manifest holds follows the number of dates and sources.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentry import schemas
from evidentry.operators.integrity import permitted
from evidentry.operators.rollups import dirty_minutes, recompute
from evidentry.session import materialize


class EvidenceConflict(ValueError):
    """An identity came again with other content."""


class EvidenceRegression(ValueError):
    """A resolved line came again as unresolved."""


class CursorRegression(ValueError):
    """A cursor lies before the stored one."""


class CursorGap(ValueError):
    """A cursor skips bytes that no record covers."""


class IllegalTransition(ValueError):
    """A deployment's status can't follow its stored one."""


def differing(columns: Sequence[str], left: str = "", right: str = "stored_"):
    """The names of the columns whose values differ; null equals null."""
    return F.array_compact(F.array(*[F.when(~F.col(left + c).eqNullSafe(F.col(right + c)), F.lit(c)) for c in columns]))


def split_batch(batch: DataFrame, stored: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """``batch`` with outcome (inserted, duplicate or conflict) and the differing columns.

    A key that comes twice in a batch is compared with its first version too.
    """
    known = stored.select(F.col(key), *[F.col(c).alias(f"stored_{c}") for c in content], F.lit(True).alias("known"))
    joined = batch.join(known, key, "left").withColumn("differs", F.when(F.col("known"), differing(content)).otherwise(F.array().cast("array<string>")))
    outcome = F.when(F.col("known").isNull(), "inserted").when(F.size("differs") == 0, "duplicate").otherwise("conflict")
    return joined.withColumn("outcome", outcome).select(*batch.columns, "outcome", "differs")


def latest_snapshot(rows: DataFrame, key: str, count: str, sequence: str) -> DataFrame:
    """Of each key the row of the highest count, then of the highest sequence: stale snapshots give way."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(count, sequence)).alias("row"))
    return newest.select("row.*")


def replaced_snapshots(stored: DataFrame, incoming: DataFrame, key: str, count: str, uid: str = "uid") -> tuple[DataFrame, DataFrame]:
    """(rows to delete, rows to insert) when newer snapshots of the same object arrive; a lower count is an older one and is dropped."""
    newest = latest_snapshot(incoming, key, count, uid)
    old = stored.select(key, F.col(count).alias("old_count"), F.col(uid).alias("old_uid"))
    joined = newest.join(old, key, "left")
    fresh = joined.where("old_uid IS NULL OR (old_uid <> uid AND NOT coalesce(" + count + " < old_count, false))")
    fresh = fresh.select(*newest.columns, "old_uid")
    return stored.join(fresh.where("old_uid IS NOT NULL").select(F.col("old_uid").alias(uid)), uid, "left_semi"), fresh.drop("old_uid")


def apply_deployments(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The deployments after an export: new ones added, permitted steps taken; any other step raises."""
    given = incoming.dropDuplicates(["uid"])
    now = given.select("uid", F.col("status").alias("new_status"), F.col("finished_at").alias("new_finished"), F.lit(True).alias("given"))
    both = stored.join(now, "uid", "left")
    same = F.col("status").eqNullSafe(F.col("new_status")) & F.col("finished_at").eqNullSafe(F.col("new_finished"))
    bad = both.where(F.col("given") & ~same & ~permitted(F.col("status"), F.col("new_status"))).select("uid", "status", "new_status").limit(5).collect()
    if bad:
        raise IllegalTransition("; ".join(f"{r.uid}: {r.status} to {r.new_status}" for r in bad))
    kept = both.withColumn("status", F.coalesce("new_status", "status")).withColumn("finished_at", F.when(F.col("given"), F.col("new_finished")).otherwise(F.col("finished_at")))
    return kept.select(*stored.columns).unionByName(given.join(stored.select("uid"), "uid", "left_anti").select(*stored.columns))


def insert_new(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Adds rows of unseen keys and leaves the others as they are."""
    return stored.unionByName(incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti").select(*stored.columns))


def checked_offsets(drafts: DataFrame) -> DataFrame:
    """``drafts``; an offset that isn't a number of bytes, 0 or more, raises."""
    at = F.col("source_offset")
    bad = F.raise_error(F.concat(F.lit("source_offset has to be a number of bytes, 0 or more: "), F.coalesce(at.cast("string"), F.lit("null")))).cast("long")
    return drafts.withColumn("source_offset", F.when(F.coalesce(at >= 0, F.lit(False)), at).otherwise(bad))


def unresolved_report(unresolved: DataFrame) -> DataFrame:
    return unresolved.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def consumed_bytes(records: DataFrame, *keys: str) -> DataFrame:
    """UTF-8 bytes of the records' text by key, line ends left out."""
    return records.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length("raw").cast("long")), F.lit(0)).alias("bytes"), F.count("*").alias("records"))


def check_cursor(source: str, stored: int, cursor: int, consumed: int) -> None:
    if isinstance(cursor, bool) or not isinstance(cursor, int) or cursor < 0:
        raise ValueError("a cursor is a number of bytes, 0 or more")
    if cursor < stored:
        raise CursorRegression(f"{source}: {cursor} < {stored}")
    if cursor > stored + consumed:
        raise CursorGap(f"{source}: {cursor} > {stored + consumed}")


@dataclass(frozen=True)
class IngestReport:
    """What became of a batch's records; each counts once."""

    inserted: int
    duplicates: int
    promoted: int
    unresolved: int


TABLES = {
    "services": schemas.SERVICES, "commits": schemas.COMMITS, "deployments": schemas.DEPLOYMENTS, "infra_changes": schemas.INFRA_CHANGES,
    "log_events": schemas.LOG_EVENTS, "unresolved_events": schemas.UNRESOLVED_EVENTS, "rollups": schemas.ROLLUPS, "postmortems": schemas.POSTMORTEMS,
    "chunks": schemas.CHUNKS, "incidents": schemas.INCIDENTS, "identities": schemas.IDENTITIES, "cluster_events": schemas.CLUSTER_EVENTS,
}
#: Tables kept by the date of a time column; a batch adds to its dates or replaces them, and leaves the others alone.
DATED = {"log_events": "ts", "rollups": "bucket_start", "identities": "on_date"}


@dataclass
class EvidenceStore:
    """Snapshots of the evidence tables under ``root``, on any file system that Hadoop can rename in.

    ``identities`` has the uid and a hash of the content of every log event: new batches are
    compared with that narrow table and not with the events themselves. An identity holds the
    line's text and with it its time, so a batch is compared with its own dates and the days
    beside them (a service's zone may have been set anew); what it reads does not grow with the history.
    """

    spark: SparkSession
    root: str
    tables: dict[str, str] = field(default_factory=lambda: dict(TABLES))

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._path(folder))] if fs.exists(self._path(folder)) else []

    def manifest(self) -> dict:
        """The newest manifest: version, folders of each table, folders by date of each dated table, a cursor for each source."""
        versions = [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json") and n[0] != "."]
        if not versions:
            return {"version": 0, "tables": {}, "dates": {}, "cursors": {}, "last_id": 0}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{max(versions):012d}.json", wholetext=True).first().value)

    def read(self, name: str, days: Collection[date | str] | None = None) -> DataFrame:
        """A table of the current snapshot; of a dated one only the ``days`` given."""
        manifest, ddl = self.manifest(), self.tables[name]
        if name in DATED:
            wanted = None if days is None else set(map(str, days))
            kept = {d: f for d, f in manifest["dates"].get(name, {}).items() if wanted is None or d in wanted}
            paths = [f"{self.root}/data/{name}/{folder}/on={d}" for d, folders in sorted(kept.items()) for folder in folders]
            base = self.spark.read.option("basePath", f"{self.root}/data/{name}").schema(f"{ddl}, batch string, on date")
            return base.parquet(*paths).drop("batch", "on") if paths else self.spark.createDataFrame([], ddl)
        folders = manifest["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.root}/data/{name}/{f}" for f in folders])

    def publish(self, changed: dict[str, DataFrame] | None = None, cursors: dict[str, int] | None = None, added: dict[str, DataFrame] | None = None, dates: dict[str, list[str]] | None = None, last_id: int | None = None) -> int:
        """Writes tables and makes them visible together.

        ``changed`` tables are replaced, ``added`` rows go beside those there are. A dated table is
        replaced only on ``dates[name]``, which has to cover the rows given; without it on all.
        """
        before = self.manifest()
        tables = {k: list(v) for k, v in before["tables"].items()}
        dated = {k: {d: list(f) for d, f in v.items()} for k, v in before["dates"].items()}
        for more, given in ((False, changed or {}), (True, added or {})):
            for name, rows in given.items():
                folder = f"batch={uuid.uuid4().hex}"
                path = f"{self.root}/data/{name}/{folder}"
                rows = rows.select(*_columns(self.tables[name]))
                if name not in DATED:
                    rows.write.parquet(path)
                    tables[name] = (tables.get(name, []) if more else []) + [folder]
                    continue
                # A date's rows meet in a few tasks first: else each task would write a file for each date.
                rows.withColumn("on", F.to_date(DATED[name])).hint("rebalance", "on").write.partitionBy("on").parquet(path)
                written = sorted(n.removeprefix("on=") for n in self._names(f"data/{name}/{folder}") if n.startswith("on="))
                held = dated.setdefault(name, {})
                if not more:
                    for d in (dates or {}).get(name, list(held)):
                        held.pop(d, None)
                for d in written:
                    held[d] = held.get(d, []) + [folder]
        after = {"version": before["version"] + 1, "tables": tables, "dates": dated, "cursors": before["cursors"] | (cursors or {}), "last_id": before["last_id"] if last_id is None else last_id}
        fs, draft = self._fs(), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        if not fs.rename(draft, self._path(f"manifests/{after['version']:012d}.json")):
            raise RuntimeError("another writer published this version first")
        return after["version"]

    def compact(self, name: str, most: int = 8) -> int:
        """Rewrites the dates of a dated table that are spread over more than ``most`` folders into one each."""
        spread = [d for d, f in self.manifest()["dates"].get(name, {}).items() if len(f) > most]
        for d in spread:
            self.publish({name: self.read(name, [d])}, dates={name: [d]})
        return len(spread)

    def cursor(self, source: str) -> int:
        return int(self.manifest()["cursors"].get(source, 0))

    def _rebuilt(self, touched: DataFrame, extra: DataFrame | None = None, without: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """The rollups of the dates that ``touched`` events lie on, their minutes rebuilt; and those dates.

        Only those dates' rollups and events are read, with ``extra`` events and less those of ``without``.
        """
        days = _days(touched)
        if not days:
            return self.spark.createDataFrame([], schemas.ROLLUPS), []
        events, rollups = self.read("log_events", days), self.read("rollups", days)
        if without is not None:
            events = events.join(without.select("uid"), "uid", "left_anti").select(*events.columns)
        if extra is not None:
            events = events.unionByName(extra.select(*events.columns))
        return recompute(events, rollups, materialize(dirty_minutes(touched, rollups), "dirty")), days

    def _known(self, days: list[str], untimed: int) -> DataFrame:
        """The identities that a batch on these days may have; all, if some of its lines have no time."""
        near = {date.fromisoformat(d) + timedelta(days=k) for d in days for k in (-2, -1, 0, 1, 2)}
        return self.read("identities", None if untimed else near)

    def ingest(self, drafts: DataFrame, cursors: dict[str, int] | None = None, gone: DataFrame | None = None, changed: dict[str, DataFrame] | None = None) -> IngestReport:
        """Takes a batch of log drafts: rows with a reason are unresolved, the others log events.

        Equal repeats are duplicates, other content under a known uid raises, a resolved line that
        was unresolved before moves over, and the reverse raises. Touched minutes are rebuilt.
        Sequence numbers continue in (source_file, source_offset) order. In the same snapshot log
        events ``gone`` (uid, service_id, ts) leave, and ``changed`` tables are replaced. All counts
        are observed while the batch's parts are written.
        """
        seen, met, left = Observation(), Observation(), Observation()
        resolved_line = F.col("reason").isNull()
        drafts = materialize(checked_offsets(drafts).observe(seen, F.count_if(resolved_line).alias("good"), F.count_if(~resolved_line).alias("bad"), F.count_if(F.col("ts").isNull()).alias("untimed")), "drafts")
        known, unresolved, before = self._known(_days(drafts), seen.get["untimed"]), self.read("unresolved_events"), self.manifest()
        for source, cursor in (cursors or {}).items():
            used = drafts.where(F.col("source_file") == source).agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("n")).first().n
            check_cursor(source, self.cursor(source), cursor, int(used))
        good, bad = drafts.where("reason IS NULL").withColumn("content", F.xxhash64(*schemas.LOG_CONTENT)), drafts.where("reason IS NOT NULL")
        self._refuse(good.groupBy("uid").agg(F.count_distinct("content").alias("n")).where("n > 1"), EvidenceConflict)
        waited = unresolved.select("uid", F.lit(True).alias("waited"))
        outcomes = split_batch(good.dropDuplicates(["uid"]), known, "uid", ("content",)).join(waited, "uid", "left")
        is_new = F.col("outcome") == "inserted"
        counts = [F.count_if(is_new).alias("new"), F.count_if(is_new & F.col("waited")).alias("promoted"), F.count_if(F.col("outcome") == "conflict").alias("conflict")]
        resolved = materialize(outcomes.observe(met, *counts), "resolved").drop("waited")
        if met.get["conflict"]:
            rows = resolved.where("outcome = 'conflict'").limit(5).drop("outcome", "differs")
            days = [r[0] for r in rows.join(known.select("uid", "on_date"), "uid").select("on_date").distinct().collect()]
            self._refuse(split_batch(rows, self.read("log_events", days), "uid", schemas.LOG_CONTENT), EvidenceConflict)
        self._refuse(bad.join(known.select("uid"), "uid", "left_semi"), EvidenceRegression)
        open_ = materialize(split_batch(bad.dropDuplicates(["uid"]), unresolved, "uid", schemas.UNRESOLVED_CONTENT), "open")
        self._refuse(open_.where("outcome = 'conflict'"), EvidenceConflict)
        new = resolved.where("outcome = 'inserted'")
        waiting = open_.where("outcome = 'inserted'").join(new.select("uid"), "uid", "left_anti")
        waiting = materialize(waiting.observe(left, F.count(F.lit(1)).alias("n")), "waiting")
        n_new, n_promoted, n_open = met.get["new"], met.get["promoted"], left.get["n"]
        numbered = materialize(_numbered(new, before["last_id"]), "new-events")
        minutes = numbered.select("uid", "service_id", "ts")
        fresh, days = self._rebuilt(minutes if gone is None else minutes.unionByName(gone.select("uid", "service_id", "ts")), extra=numbered, without=gone)
        changed, dates = {"rollups": fresh, **(changed or {})}, {"rollups": days}
        added = {"log_events": numbered, "unresolved_events": waiting, "identities": numbered.withColumn("on_date", F.to_date("ts"))}
        if gone is not None and (dates_gone := _days(gone)):
            changed["log_events"], dates["log_events"] = self.read("log_events", dates_gone).join(gone.select("uid"), "uid", "left_anti"), dates_gone
        if n_promoted:  # only then are unresolved lines rewritten
            changed["unresolved_events"] = unresolved.join(new.select("uid"), "uid", "left_anti").select(*unresolved.columns).unionByName(waiting.select(*unresolved.columns))
            del added["unresolved_events"]
        self.publish(changed, cursors, added, dates, before["last_id"] + n_new)
        return IngestReport(n_new - n_promoted, seen.get["good"] - n_new + seen.get["bad"] - n_open, n_promoted, n_open)

    def ingest_snapshots(self, found: DataFrame) -> IngestReport:
        """Takes drafts that are snapshots of events (event_uid, occurrence_count): newer ones take the place of older ones, all in one publication.

        What is stored of an event is asked of the narrow table of newest snapshots.
        """
        found, stored = materialize(found, "snapshots"), self.read("cluster_events")
        gone, fresh = replaced_snapshots(stored, found, "event_uid", "occurrence_count")
        gone, fresh = materialize(gone.select("uid", "service_id", "ts"), "gone"), materialize(fresh, "fresh")
        newest = fresh.where("reason IS NULL").select(*stored.columns)
        kept = stored.join(newest.select("event_uid"), "event_uid", "left_anti").select(*stored.columns).unionByName(newest)
        return self.ingest(fresh.drop("event_uid", "occurrence_count"), gone=gone, changed={"cluster_events": kept})

    @staticmethod
    def _refuse(rows: DataFrame, error: type[ValueError]) -> None:
        found = rows.limit(5).collect()
        if found:
            raise error("; ".join(f"{r.uid}" + (f" ({', '.join(r.differs)})" if "differs" in rows.columns else "") for r in found))


def _days(rows: DataFrame) -> list[str]:
    """The dates that the rows' times lie on: one row a date reaches the driver."""
    return sorted(str(r[0]) for r in rows.where("ts IS NOT NULL").select(F.to_date("ts")).distinct().collect())


def _columns(ddl: str) -> list[str]:
    return [f.split(" ")[0] for f in _fields(ddl)]


def _fields(ddl: str) -> list[str]:
    """The columns of a schema, split at the commas outside brackets."""
    depth, parts, part = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(part.strip())
            part = ""
        else:
            part += c
    return [*parts, part.strip()]


def _numbered(rows: DataFrame, last: int, slices: int = 64) -> DataFrame:
    """Ids after ``last`` in (source_file, source_offset, uid) order.

    Rows are dealt to ranges of that order and numbered inside each; the ranges' sizes, a few
    numbers, give where each starts.
    """
    order = ["source_file", "source_offset", "uid"]
    ranged = materialize(rows.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "ranged")
    sizes = dict(ranged.groupBy("slice").count().collect())
    starts, total = [], last
    for s in sorted(sizes):
        starts.append((s, total))
        total += sizes[s]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "slice int, before long"))  # one row a range
    place = F.row_number().over(W.partitionBy("slice").orderBy(*order))
    return ranged.join(before, "slice").withColumn("id", (F.col("before") + place).cast("long")).drop("slice", "before")
