"""What changed around an incident: deployments, standalone commits and infrastructure, by service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.functions import citations
from evidentry.functions.times import Window


def deployed(deployments: DataFrame, commits: DataFrame, window: Window) -> DataFrame:
    """Deployments started in the window, with their commits, however old those are."""
    own = deployments.where(window.holds(F.col("started_at")))
    taken = commits.select(F.col("sha").alias("commit_sha"), "message", "authored_at", "committed_at")
    return own.join(taken, "commit_sha")


def standalone_commits(commits: DataFrame, deployments: DataFrame, window: Window) -> DataFrame:
    """Commits of the window that their own service did not deploy inside it."""
    shipped = deployments.where(window.holds(F.col("started_at"))).select("service_id", F.col("commit_sha").alias("sha"))
    return commits.where(window.holds(F.col("committed_at"))).join(shipped, ["service_id", "sha"], "left_anti")


def infra_in(changes: DataFrame, window: Window) -> DataFrame:
    return changes.where(window.holds(F.col("applied_at")))


def unattributed(changes: DataFrame, window: Window) -> DataFrame:
    return infra_in(changes, window).where("service_id IS NULL")


def change_stream(commits: DataFrame, deployments: DataFrame, infra: DataFrame, window: Window) -> DataFrame:
    """(service_id, kind, at, cite): all three kinds of change of all services, in one set-based plan."""
    parts = [
        deployed(deployments, commits, window).select("service_id", F.lit("deployment").alias("kind"), F.col("started_at").alias("at"), citations.deploy(F.col("uid")).alias("cite")),
        standalone_commits(commits, deployments, window).select("service_id", F.lit("commit").alias("kind"), F.col("committed_at").alias("at"), citations.commit(F.col("sha")).alias("cite")),
        infra_in(infra, window).select("service_id", F.lit("infra").alias("kind"), F.col("applied_at").alias("at"), citations.infra(F.col("uid")).alias("cite")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def by_service(stream: DataFrame, services: DataFrame) -> DataFrame:
    """One row a service that has changes: counts, and its citations from the newest to the oldest, then by citation."""
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("back"), "cite")))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    grouped = stream.where("service_id IS NOT NULL").groupBy("service_id").agg(count("commit").alias("commits"), count("deployment").alias("deployments"), count("infra").alias("infra_changes"), newest.alias("found"))
    named = services.select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    return grouped.join(named, "service_id").withColumn("cites", F.transform("found", lambda x: x["cite"])).drop("found")


def commit_reference() -> Column:
    return F.struct(citations.commit(F.col("sha")).alias("cite"), "sha", "message", "authored_at", "committed_at", F.array_sort("files_changed").alias("files_changed"))
