"""Which service a record belongs to: by name, log key, pod name, repository, tags, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.functions.texts import component, repository

NO_MATCH, AMBIGUOUS = "no_service_match", "ambiguous_service"
_REPLICA = r"-[A-Za-z0-9]{10}-[A-Za-z0-9]{5}\z"
_STATEFUL = r"-[0-9]+\z"


def pod_candidates(name: Column) -> Column:
    """A pod's name and what is left of it after each suffix that a controller may have added; a name has fewer suffixes than parts between hyphens."""

    def strip(last: Column) -> Column:
        once = F.regexp_replace(last, _REPLICA, "")
        return F.when(once != last, once).otherwise(F.regexp_replace(last, _STATEFUL, ""))

    return F.array_distinct(F.aggregate(F.split(name, "-"), F.array(name), lambda seen, _: F.array_append(seen, strip(F.element_at(seen, -1)))))


def _index(services: DataFrame, column: str) -> DataFrame:
    return services.select(F.explode(column).alias("key"), F.col("id").alias("found"))


def resolve(records: DataFrame, services: DataFrame, key: str = "record_id") -> DataFrame:
    """``records`` with service_id and reason.

    Records may have name, log_key, k8s_name, repo and infra_tags; what is absent counts as
    null. A name that is present decides alone, as do a log key and a well-formed repository. ``key`` is unique.
    Lookups are equi-joins on each identifier; tags meet services on a shared tag, one entry
    each, so no join pairs every record with every service.
    """
    kinds = {"name": "string", "log_key": "string", "k8s_name": "string", "repo": "string", "infra_tags": "map<string,string>"}
    full = records
    for column, kind in kinds.items():
        if column not in records.columns:
            full = full.withColumn(column, F.lit(None).cast(kind))
    names = services.select(F.col("name").alias("key"), F.col("id").alias("by_name"))
    logs = _index(services, "log_keys").withColumnRenamed("found", "by_log")
    repos = services.select(repository(F.col("repo")).alias("key"), F.col("id").alias("by_repo")).where("key IS NOT NULL")
    out = full.withColumn("name_key", component(full["name"])).join(names.withColumnRenamed("key", "name_key"), "name_key", "left").drop("name_key")
    out = out.join(logs.withColumnRenamed("key", "log_key"), "log_key", "left")
    out = out.withColumn("repo_key", repository(F.col("repo"))).join(repos.withColumnRenamed("key", "repo_key"), "repo_key", "left")
    pods = full.where("k8s_name IS NOT NULL").select(key, F.posexplode(pod_candidates(F.col("k8s_name"))).alias("step", "key"))
    pods = pods.join(_index(services, "k8s_names"), "key").groupBy(key).agg(F.min_by("found", "step").alias("by_pod"))
    out = out.join(pods, key, "left")
    out = out.join(tag_matches(full, services, key), key, "left")
    by_tags = F.when(F.col("tag_matches") == 1, F.col("tag_service"))
    service = (
        F.when(F.col("name").isNotNull(), F.col("by_name"))
        .when(F.col("log_key").isNotNull(), F.col("by_log"))
        .when(F.col("by_pod").isNotNull(), F.col("by_pod"))
        .when(F.col("repo_key").isNotNull(), F.col("by_repo"))
        .otherwise(by_tags)
    )
    to_tags = F.col("name").isNull() & F.col("log_key").isNull() & F.col("by_pod").isNull() & F.col("repo_key").isNull()
    reason = F.when(service.isNotNull(), F.lit(None)).when(to_tags & (F.col("tag_matches") > 1), AMBIGUOUS).otherwise(NO_MATCH)
    return out.withColumn("service_id", service).withColumn("reason", reason).select(*records.columns, "service_id", "reason")


def tag_matches(records: DataFrame, services: DataFrame, key: str) -> DataFrame:
    """(key, tag_matches, tag_service): services all of whose tags a record carries.

    Both sides are exploded to single tags and joined on tag and value; a service matches when
    as many of its tags met as it has.
    """
    given = records.where("infra_tags IS NOT NULL").select(key, F.explode("infra_tags").alias("tag", "value"))
    needed = services.where(F.size("infra_tags") > 0).select(F.col("id").alias("tag_service"), F.size("infra_tags").alias("needs"), F.explode("infra_tags").alias("tag", "value"))
    met = given.join(needed, ["tag", "value"]).groupBy(key, "tag_service").agg(F.count("*").alias("n"), F.first("needs").alias("needs"))
    return met.where("n = needs").groupBy(key).agg(F.count("*").alias("tag_matches"), F.min("tag_service").alias("tag_service"))


def registry_conflicts(services: DataFrame) -> DataFrame:
    """(label, value, names): identifiers that two services claim, and pairs of tag sets that one record could satisfy."""
    claims = [services.select(F.lit("name").alias("label"), F.col("name").alias("value"), "name")]
    claims += [services.select(F.lit(label).alias("label"), F.explode(column).alias("value"), "name").distinct() for label, column in (("log_key", "log_keys"), ("k8s_name", "k8s_names"))]
    claims.append(services.select(F.lit("repo").alias("label"), repository(F.col("repo")).alias("value"), "name").where("value IS NOT NULL"))
    union = claims[0]
    for c in claims[1:]:
        union = union.unionByName(c)
    doubled = union.groupBy("label", "value").agg(F.sort_array(F.collect_list("name")).alias("names")).where("size(names) > 1")
    tagged = services.where(F.size("infra_tags") > 0).select("name", "infra_tags")
    a, b = tagged.alias("a"), tagged.alias("b")
    # The registry is a small configuration file: every pair of its tagged services has to be compared.
    agree = F.forall(F.map_entries("a.infra_tags"), lambda e: F.coalesce(F.try_element_at(F.col("b.infra_tags"), e["key"]) == e["value"], F.lit(True)))
    pairs = a.join(b, (F.col("a.name") < F.col("b.name")) & agree)
    return doubled.unionByName(pairs.select(F.lit("infra_tags").alias("label"), F.lit("").alias("value"), F.array("a.name", "b.name").alias("names")))
