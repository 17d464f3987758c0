"""Rules that the storage does not enforce: domains, uniqueness, references, lifecycles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.schemas import CHUNK_KINDS, DEPLOY_STATUSES, INFRA_ACTIONS, LEVELS, REASONS, STATUS_CLASSES


def permitted(before: Column, after: Column) -> Column:
    """Whether a deployment may go from one status to the other."""
    return ((before == "in_progress") & after.isin("success", "failed", "rolled_back")) | ((before == "success") & (after == "rolled_back"))


def transitions(spark: SparkSession) -> DataFrame:
    """Every pair of the four statuses, and whether the step is permitted."""
    statuses = spark.createDataFrame([(s,) for s in DEPLOY_STATUSES], "before string")
    pairs = statuses.select("before", F.explode(F.array(*map(F.lit, DEPLOY_STATUSES))).alias("after"))
    return pairs.withColumn("permitted", permitted(F.col("before"), F.col("after")))


def doubled(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).count().where("count > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference no parent has; a null reference refers to nothing."""
    keys = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.where(F.col(key).isNotNull()).join(keys, key, "left_anti")


def violations(rows: DataFrame, rules: Mapping[str, Column], references: Mapping[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """(rule, n): rows that break each domain rule (null passes, as in SQL), counted in one pass, and orphans of each reference."""
    counted = rows.agg(*[F.count_if(~condition).alias(name) for name, condition in rules.items()])
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])
    out = counted.select(F.inline(entries))
    for name, (parents, key, parent_key) in (references or {}).items():
        out = out.unionByName(orphans(rows, parents, key, parent_key).agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n"))
    return out


def source_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _one_of(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isin(*values)


def domain_rules() -> dict[str, dict[str, Column]]:
    """Each table's rules on single rows."""
    uid = {"uid": F.col("uid").rlike("^[0-9a-f]{32}$")}
    return {
        "commits": {"sha": F.col("sha").rlike("^[0-9a-f]{40}$"), "paths": F.forall("files_changed", lambda f: F.coalesce(F.length(f["path"]) > 0, F.lit(False)))},
        "deployments": uid | {"status": _one_of("status", DEPLOY_STATUSES)},
        "infra_changes": uid | {"action": _one_of("action", INFRA_ACTIONS)},
        "log_events": uid | {"level": _one_of("level", LEVELS), "template_hash": F.col("template_hash").rlike("^[0-9a-f]{32}$"), "service": F.col("service_id").isNotNull()},
        "unresolved_events": uid | {"reason": _one_of("reason", REASONS)},
        "rollups": {"count": F.col("count") > 0, "status_class": _one_of("status_class", STATUS_CLASSES), "level": _one_of("level", LEVELS)},
        "chunks": {"kind": _one_of("kind", CHUNK_KINDS)},
    }


UNIQUE = {
    "services": ("name",), "commits": ("sha",), "deployments": ("uid",), "infra_changes": ("uid",), "log_events": ("uid",), "unresolved_events": ("uid",),
    "rollups": ("service_id", "bucket_start", "status_class", "level", "template_hash"), "postmortems": ("slug",), "chunks": ("slug", "ordinal"), "incidents": ("dedup_key",),
}
REFERENCES = {
    "deployments": ("commits", "commit_sha", "sha"), "rollups": ("log_events", "exemplar_id", "id"), "chunks": ("postmortems", "slug", "slug"),
    "commits": ("services", "service_id", "id"), "infra_changes": ("services", "service_id", "id"), "log_events": ("services", "service_id", "id"),
}


def snapshot_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rule, n): everything in a snapshot that breaks a domain, a unique key or a reference; rules that hold are left out."""
    rules, out = domain_rules(), None
    for name, rows in tables.items():
        parts = []
        references = {f"{key} in {parent}": (tables[parent], key, parent_key) for n, (parent, key, parent_key) in REFERENCES.items() if n == name and parent in tables}
        if name in rules:
            parts.append(violations(rows, rules[name], references))
        if name in UNIQUE:
            parts.append(doubled(rows, *UNIQUE[name]).agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n"))
        for p in parts:
            p = p.select(F.lit(name).alias("table"), "rule", "n")
            out = p if out is None else out.unionByName(p)
    return out.where("n > 0")
