"""Small configuration files read on the driver: services, log manifests, scenarios."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from evidentry import schemas
from evidentry.operators.resolve import registry_conflicts


def _yaml(spark: SparkSession, path: str) -> Any:
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value)


def _typed(value: Any, kind: type, name: str, default: Any) -> Any:
    if value is None:
        return default
    if not isinstance(value, kind) or isinstance(value, list) and not all(isinstance(x, str) for x in value):
        raise ValueError(f"{name} is not of the expected type")
    return value


def service_rows(entries: Any) -> list[tuple]:
    """Typed rows of the services table, numbered by name; defaults fill what is left out."""
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("a registry is a list of objects")
    rows = []
    for number, e in enumerate(sorted(entries, key=lambda e: str(e.get("name"))), 1):
        tags = {str(k): str(v) for k, v in _typed(e.get("infra_tags"), dict, "infra_tags", {}).items()}
        name = _typed(e.get("name"), str, "name", None)
        if name is None:
            raise ValueError("a service needs a name")
        lists = [_typed(e.get(k), list, k, []) for k in ("log_keys", "k8s_names")]
        rows.append((number, name, _typed(e.get("repo"), str, "repo", None), *lists, tags, _typed(e.get("log_timezone"), str, "log_timezone", "UTC")))
    return rows


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """The services table; identifiers that two services claim raise before anything is written."""
    services = spark.createDataFrame(service_rows(_yaml(spark, path)), schemas.SERVICES)
    clashes = registry_conflicts(services).collect()
    if clashes:
        raise ValueError("; ".join(f"{r.label} {r.value}: {', '.join(r.names)}" for r in clashes))
    return services


def upsert_services(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Services by name: known ones keep their id and take the new values, new ones follow the highest id."""
    from pyspark.sql import functions as F

    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n
    ids = stored.select("name", F.col("id").alias("old_id"))
    both = incoming.join(ids, "name", "left").withColumn("id", F.coalesce("old_id", F.col("id") + top)).select(*stored.columns)
    return stored.join(incoming.select("name"), "name", "left_anti").unionByName(both)


def read_log_manifest(spark: SparkSession, path: str, prefix: str = "logs/") -> DataFrame:
    """(source_file, service, format) of each declared log file."""
    entries = _yaml(spark, path)
    if not isinstance(entries, dict):
        raise ValueError("a log manifest is an object by file name")
    rows = [(prefix + name, e.get("service"), e.get("format")) for name, e in entries.items()]
    return spark.createDataFrame(rows, "source_file string, service string, format string")


def scenario_request(scenario: dict) -> dict:
    """A scenario's alert, with allowed keys alone: what it expects never reaches a query."""
    allowed = ("service", "alert_name", "fired_at", "window_start", "window_end", "payload")
    return {k: scenario["alert"][k] for k in allowed if k in scenario["alert"]}


def repeated_scenarios(scenarios: list[dict]) -> list[str]:
    """Names and dedup keys that more than one scenario has."""
    seen: dict[str, int] = {}
    for s in scenarios:
        for value in (s["name"], s["alert"].get("dedup_key")):
            if value is not None:
                seen[value] = seen.get(value, 0) + 1
    return sorted(v for v, n in seen.items() if n > 1)
