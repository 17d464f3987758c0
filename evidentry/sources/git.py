"""Repository exports: commits with their files, and deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.functions.identity import deployment_uid
from evidentry.functions.texts import repository

FILE = "struct<path:string,status:string,additions:int,deletions:int,hunks:string>"
COMMIT = f"struct<sha:string,author:string,authored_at:string,committed_at:string,message:string,pr_number:int,files_changed:array<{FILE}>>"
EXPORT = f"repo string, commits array<{COMMIT}>, deploys array<struct<commit_sha:string,environment:string,started_at:string,finished_at:string,status:string>>"
KEYS = {"$": ("repo", "commits", "deploys")}
MAX_FILES, MAX_HUNKS, MAX_LINES = 15, 3, 60


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row an export file; a malformed file fails the read, unknown keys are refused."""
    whole = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    unknown = F.array_except(keys, F.array(*map(F.lit, KEYS["$"])))
    checked = F.when(keys.isNull() | (F.size(unknown) > 0), F.raise_error(F.concat_ws(" ", F.lit("unexpected keys in an export:"), unknown))).otherwise(F.col("value"))
    return whole.select(F.from_json(checked, EXPORT, {"mode": "FAILFAST"}).alias("e")).select("e.*").withColumn("repo", repository(F.col("repo")))


def capped_files(files: Column, max_files: int = MAX_FILES, max_hunks: int = MAX_HUNKS, max_lines: int = MAX_LINES) -> Column:
    """Files by path; patch text stays for the files of most changed lines, within the budget, else hunks_omitted says why not."""
    ranked = F.array_sort(F.transform(files, lambda f: F.struct((-(f["additions"] + f["deletions"])).alias("rank"), f["path"].alias("path"))))
    kept = F.transform(F.slice(ranked, 1, max_files), lambda r: r["path"]) if max_files else F.array().cast("array<string>")

    def one(f: Column) -> Column:
        lines = F.size(F.split(F.regexp_replace(f["hunks"], r"(\r\n|[\n\r])\z", ""), r"\r\n|[\n\r]"))
        over = (F.regexp_count(f["hunks"], F.lit("(?m)^@@")) > max_hunks) | ((lines > max_lines) & (f["hunks"] != ""))
        omitted = F.when(f["hunks"].isNull(), "webhook").when(~F.array_contains(kept, f["path"]) | over, "budget")
        return F.struct(f["path"].alias("path"), f["status"].alias("status"), f["additions"].alias("additions"), f["deletions"].alias("deletions"), F.when(omitted.isNull(), f["hunks"]).alias("hunks"), omitted.alias("hunks_omitted"))

    return F.array_sort(F.transform(files, one), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))


def _attributed(exports: DataFrame, services: DataFrame) -> DataFrame:
    named = services.select(F.col("id").alias("service_id"), repository(F.col("repo")).alias("repo"))
    missing = F.raise_error(F.concat(F.lit("no service has the repository "), F.coalesce("repo", F.lit("?"))))
    return exports.join(named, "repo", "left").withColumn("service_id", F.coalesce("service_id", missing.cast("int")))


def commits(exports: DataFrame, services: DataFrame, **budget: int) -> DataFrame:
    """The commits table of exports; a sha or path that isn't well formed, or a path listed twice, raises."""
    rows = _attributed(exports, services).select("service_id", F.inline("commits"))
    paths = F.transform("files_changed", lambda f: f["path"])
    good = F.col("sha").rlike(r"\A[0-9a-f]{40}\z") & (F.size(F.array_distinct(paths)) == F.size(paths))
    sha = F.when(good, F.col("sha")).otherwise(F.raise_error(F.concat(F.lit("malformed commit "), F.coalesce("sha", F.lit("?")))).cast("string"))
    total = lambda key: F.aggregate("files_changed", F.lit(0), lambda s, f: s + f[key])
    return rows.select(
        sha.alias("sha"), "service_id", F.to_timestamp("authored_at").alias("authored_at"), F.to_timestamp("committed_at").alias("committed_at"), "message", "author", "pr_number",
        capped_files(F.col("files_changed"), **budget).alias("files_changed"), total("additions").alias("additions"), total("deletions").alias("deletions"),
    )


def deployments(exports: DataFrame, services: DataFrame) -> DataFrame:
    """The deployments table of exports; times come from the export, never from the commit."""
    rows = _attributed(exports, services).select("service_id", F.inline("deploys"))
    rows = rows.withColumn("started_at", F.to_timestamp("started_at")).withColumn("finished_at", F.to_timestamp("finished_at"))
    return rows.select(deployment_uid(F.col("commit_sha"), F.col("environment"), F.col("started_at")).alias("uid"), "service_id", "commit_sha", "environment", "started_at", "finished_at", "status")
