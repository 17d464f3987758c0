"""Infrastructure plans joined with the applies that carried them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.functions.identity import infra_uid
from evidentry.functions.jsondiff import attribute_diff
from evidentry.operators.resolve import tag_matches

APPLY = "array<struct<apply_id:string,plan_file:string,status:string,applied_at:string>>"


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(plan_file, resource): each resource change of each plan, as JSON."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("plan_file"), "value")
    found = F.from_json(F.get_json_object("value", "$.resource_changes"), "array<string>")
    checked = F.coalesce(found, F.raise_error(F.concat(F.lit("no resource_changes in "), "plan_file")).cast("array<string>"))
    return whole.select("plan_file", F.explode(checked).alias("resource"))


def read_applies(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.inline(F.from_json("value", APPLY, {"mode": "FAILFAST"}))).withColumn("applied_at", F.to_timestamp("applied_at"))


def action(actions: Column) -> Column:
    """create, update, delete or replace; null for no-op; anything else raises."""
    words = F.array_join(actions, "+")
    known = F.when(words.isin("create", "update", "delete"), words).when(words.isin("create+delete", "delete+create"), "replace")
    bad = F.raise_error(F.concat(F.lit("unsupported actions: "), F.coalesce(words, F.lit("none")))).cast("string")
    return F.when(F.coalesce(words != "no-op", F.lit(True)), F.coalesce(known, bad))


def infra_changes(plans: DataFrame, applies: DataFrame, services: DataFrame) -> DataFrame:
    """The infra_changes table: successful applies only, each changed resource once.

    The service is that whose tags the resource carries after the change, else before it; null
    where none or several match.
    """
    get = lambda path: F.get_json_object("resource", path)
    rows = plans.join(applies.where("status = 'success'"), "plan_file")
    rows = rows.withColumn("action", action(F.from_json(get("$.change.actions"), "array<string>"))).where("action IS NOT NULL")
    rows = rows.select(
        F.coalesce(get("$.provider_name"), F.lit("terraform")).alias("provider"), get("$.type").alias("resource_type"), get("$.address").alias("resource_name"), get("$.id").alias("resource_id"), "action",
        attribute_diff(get("$.change")).alias("attribute_diff"), "applied_at", "apply_id", F.lit(None).cast("string").alias("source_ref"),
        *[F.from_json(get(f"$.change.{side}.tags"), "map<string,string>").alias(f"{side}_tags") for side in ("after", "before")],
    )
    rows = rows.withColumn("uid", infra_uid(F.col("apply_id"), F.col("resource_type"), F.col("resource_name"), F.col("action"), F.col("provider")))
    for side in ("after", "before"):
        found = tag_matches(rows.select("uid", F.col(f"{side}_tags").alias("infra_tags")).dropDuplicates(["uid"]), services, "uid")
        rows = rows.join(found.where("tag_matches = 1").select("uid", F.col("tag_service").alias(f"{side}_service")), "uid", "left")
    return rows.withColumn("service_id", F.coalesce("after_service", "before_service")).drop("after_tags", "before_tags", "after_service", "before_service")
