"""Alerts and repository pushes that arrive as JSON: keys, signatures and mapping."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentry.functions.texts import repository, sha40
from evidentry.functions.times import bucket

PUSH = "repository struct<full_name:string>, head_commit struct<id:string>, commits array<struct<id:string,timestamp:string,message:string,author:struct<name:string>,added:array<string>,modified:array<string>,removed:array<string>>>"
PULL_REQUEST = "repository struct<full_name:string>, action string, number int, pull_request struct<merged:boolean,merge_commit_sha:string,head:struct<sha:string>>"


def dedup_key(provider_id: Column, own_key: Column, service: Column, alert: Column, fired_at: Column, offset: str = "+00:00") -> Column:
    """The provider's id, else the payload's key, else a fingerprint of service, alert and the five minutes it fired in.

    ``offset`` is how the sender wrote its zone: the same instant in another zone has another fingerprint.
    """
    stamp = F.concat(F.date_format(bucket(fired_at, 5), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
    material = F.concat_ws("|", service, alert, stamp)
    return F.coalesce(provider_id, own_key, F.concat(F.lit("fp:"), F.substring(F.sha2(material, 256), 1, 32)))


def alerts(raw: DataFrame) -> DataFrame:
    """JSON texts in ``value`` -> incidents: dedup_key, dedup_source, service, opened_at, window_start, window_end, alert_payload, status."""
    get = lambda path: F.get_json_object("value", path)
    provider, own = get("$.event.data.id"), get("$.dedup_key")
    fired = F.try_to_timestamp(get("$.fired_at"))
    return raw.select(
        dedup_key(provider, own, get("$.service"), get("$.alert_name"), fired).alias("dedup_key"),
        F.when(F.coalesce(provider, own).isNotNull(), "provider").otherwise("fingerprint").alias("dedup_source"),
        get("$.service").alias("service"),
        fired.alias("opened_at"),
        F.try_to_timestamp(get("$.window_start")).alias("window_start"),
        F.try_to_timestamp(get("$.window_end")).alias("window_end"),
        F.col("value").alias("alert_payload"),
        F.lit("open").alias("status"),
    )


def new_incidents(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The first alert of each unseen key."""
    first = found.groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in found.columns if c != "dedup_key"]), F.struct("opened_at", "alert_payload")).alias("a"))
    return first.join(stored.select("dedup_key"), "dedup_key", "left_anti").select("dedup_key", "a.*")


def signature_holds(body: bytes, supplied: str | None, secret: str) -> bool:
    """Whether ``sha256=<hex>`` is the HMAC of the raw bytes, compared in constant time."""
    expected = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return supplied is not None and hmac.compare_digest(expected.encode(), supplied.encode())


def push_exports(raw: DataFrame) -> DataFrame:
    """JSON pushes in ``value`` -> (repo, error, commits): commits as the git source has them, without patch text.

    error names what makes a push unusable: no repository, a truncated list of commits, or a path that is empty or listed twice.
    """
    p = raw.select(F.from_json("value", PUSH).alias("p")).select("p.*")
    none = F.array().cast("array<string>")

    def files(c: Column) -> Column:
        def one(status: str) -> Column:
            return F.transform(F.coalesce(c[status], none), lambda path: F.struct(path.alias("path"), F.lit(status).alias("status"), F.lit(0).alias("additions"), F.lit(0).alias("deletions"), F.lit(None).cast("string").alias("hunks")))

        return F.concat(*map(one, ("added", "modified", "removed")))

    commits = F.transform(
        "commits",
        lambda c: F.struct(c["id"].alias("sha"), c["author"]["name"].alias("author"), F.try_to_timestamp(c["timestamp"]).alias("authored_at"), F.try_to_timestamp(c["timestamp"]).alias("committed_at"), c["message"].alias("message"), F.lit(None).cast("int").alias("pr_number"), files(c).alias("files_changed")),
    )
    out = p.select(repository(F.col("repository.full_name")).alias("repo"), "head_commit", F.col("commits").alias("given"), commits.alias("commits"))
    paths = lambda c: F.transform(c["files_changed"], lambda f: f["path"])
    bad_paths = F.exists("commits", lambda c: (F.size(F.array_distinct(paths(c))) < F.size(paths(c))) | F.exists(paths(c), lambda x: x == ""))
    missing = F.exists("commits", lambda c: c["sha"].isNull() | c["message"].isNull() | c["author"].isNull() | c["committed_at"].isNull())
    error = (
        F.when(F.col("repo").isNull(), "repository")
        .when(F.col("given").isNull() | missing, "commits")
        .when((F.size("given") > 0) & (F.col("head_commit.id") != F.element_at("given", -1)["id"]), "truncated")
        .when(bad_paths, "paths")
    )
    return out.select("repo", error.alias("error"), "commits")


def pull_request_numbers(raw: DataFrame) -> DataFrame:
    """JSON pull-request events in ``value`` -> (repo, number, sha): the head and the merge commit, once each."""
    p = raw.select(F.from_json("value", PULL_REQUEST).alias("p")).select("p.*")
    shas = F.array_compact(F.array_distinct(F.array(sha40(F.col("pull_request.head.sha")), sha40(F.col("pull_request.merge_commit_sha")))))
    return p.select(repository(F.col("repository.full_name")).alias("repo"), "number", F.explode(shas).alias("sha"))


def enrich_commits(commits: DataFrame, services: DataFrame, numbers: DataFrame) -> DataFrame:
    """Fills pull-request numbers that are null, where sha and repository agree; another number already there raises."""
    named = services.select(F.col("id").alias("service_id"), repository(F.col("repo")).alias("repo"))
    known = numbers.join(named, "repo").select("sha", "service_id", F.col("number").alias("given")).distinct()
    both = commits.join(known, ["sha", "service_id"], "left")
    clash = F.col("given").isNotNull() & F.col("pr_number").isNotNull() & (F.col("given") != F.col("pr_number"))
    number = F.when(clash, F.raise_error(F.concat(F.lit("another pull request is recorded for "), F.col("sha"))).cast("int")).otherwise(F.coalesce("pr_number", "given"))
    return both.withColumn("pr_number", number).select(*commits.columns)
