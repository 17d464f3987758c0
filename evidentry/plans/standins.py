"""The evidence tables as the driver's tables can stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentry.functions.texts import mask, template_hash


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id32(*parts) -> F.Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def log_events(spark: SparkSession, sf_dir: str, templates: bool = False) -> DataFrame:
    """events as log events; with ``templates`` messages go through the mask, else their type stands for the template."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    code = F.when(kind == "error", 500).when(kind == "signup", 201).when(kind == "purchase", 200).when(kind == "view", 304).otherwise(404)
    message = F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" event "), F.col("event_id").cast("string"))
    attrs = (
        F.when(F.col("event_id") % 5 == 0, F.lit('{"stack":[{"file":"a.py","line":3,"func":"f"}],"duration_ms":4.5}'))
        .when(F.col("event_id") % 5 == 1, F.lit('{"upstream":"db","exc_type":null}'))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"source":"k8s","occurrence_count":'), F.get_json_object("props", "$.k"), F.lit("}")))
        .when(F.col("event_id") % 5 == 3, F.lit('{"duration_ms":"7","stack":"none"}'))
        .otherwise(F.col("props"))
    )
    masked = mask(message) if templates else kind
    return e.select(
        F.col("event_id").alias("id"),
        _id32(F.lit("log"), "event_id").alias("uid"),
        "ts",
        (F.col("user_id") % 10).cast("int").alias("service_id"),
        F.when(kind == "error", "error").otherwise("info").alias("level"),
        code.cast("int").alias("status_code"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t-"), F.col("user_id").cast("string"))).alias("trace_id"),
        message.alias("message"),
        template_hash(masked).alias("template_hash"),
        message.alias("raw"),
        attrs.alias("attrs"),
        F.lit("logs/events.log").alias("source_file"),
        (F.col("event_id") * 64).alias("source_offset"),
    )


def services(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("name"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.sha1(F.col("o_orderkey").cast("string")).alias("sha"),
        (F.col("o_custkey") % 10).cast("int").alias("service_id"),
        F.col("o_orderdate").alias("authored_at"),
        F.col("o_orderdate").alias("committed_at"),
        F.col("o_orderpriority").alias("message"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        _id32(F.lit("deploy"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        (F.col("l_suppkey") % 10).cast("int").alias("service_id"),
        F.sha1(F.col("l_orderkey").cast("string")).alias("commit_sha"),
        F.col("l_returnflag").alias("environment"),
        F.col("l_shipdate").alias("started_at"),
        F.when(F.col("l_linestatus") == "F", "success").otherwise("in_progress").alias("status"),
    )


def infra_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        _id32(F.lit("infra"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
        F.when(F.col("l_returnflag") != "N", (F.col("l_partkey") % 10).cast("int")).alias("service_id"),
        F.col("l_shipdate").alias("applied_at"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("resource_name"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select(
        F.concat(F.lit("doc-"), F.col("label").cast("string")).alias("slug"),
        F.col("vec_id").cast("int").alias("ordinal"),
        F.when(F.col("vec_id") % 7 == 0, "resolution").otherwise("section").alias("kind"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"),
        "embedding",
    )


def postmortems(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = chunks(spark, sf_dir).select("slug").distinct()
    return slugs.select(
        "slug",
        F.concat(F.lit("Review "), "slug").alias("title"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        F.array(F.lit("svc-1"), "slug").alias("services"),
        F.lit(None).cast("string").alias("resolution_md"),
        F.sha2("slug", 256).alias("content_sha"),
    )


#: The same tables for DuckDB, to be put before a query.
LOG_SQL = """log_events AS (
  SELECT event_id AS id, substr(sha256('log:' || event_id), 1, 32) AS uid, ts, (user_id % 10)::INT AS service_id,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 WHEN 'purchase' THEN 200 WHEN 'view' THEN 304 ELSE 404 END AS status_code,
    CASE WHEN event_id % 3 > 0 THEN 't-' || user_id END AS trace_id,
    substr(sha256(event_type), 1, 32) AS template_hash,
    (event_id % 3 > 0)::INT + (CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS rich,
    event_id % 5 = 2 AS counts, json_extract_string(props, '$.k')::BIGINT AS k, event_type, user_id, props,
    'svc-' || (user_id % 10) AS service, date_trunc('minute', ts)::TIMESTAMP AS bucket_start
  FROM events),
  stood AS (SELECT *, CASE WHEN status_code BETWEEN 100 AND 599 THEN (status_code // 100)::VARCHAR || 'xx' ELSE 'none' END AS status_class FROM log_events),
  rollups AS (
  SELECT service_id, service, bucket_start, status_class, level, template_hash, count(*)::BIGINT AS count, min(ts) AS first_seen, max(ts) AS last_seen,
    arg_min(id, row(-rich, id)) AS exemplar_id,
    'rollup:' || service || '/' || strftime(bucket_start, '%Y-%m-%dT%H:%M:%SZ') || '/' || status_class || '/' || level || '/' || template_hash AS cite
  FROM stood GROUP BY ALL)"""
CHANGE_SQL = """commits AS (SELECT sha1(o_orderkey::VARCHAR) AS sha, (o_custkey % 10)::INT AS service_id, o_orderdate AS committed_at, o_orderpriority AS message FROM orders),
  deployments AS (SELECT substr(sha256('deploy:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 32) AS uid, (l_suppkey % 10)::INT AS service_id,
    sha1(l_orderkey::VARCHAR) AS commit_sha, l_returnflag AS environment, l_shipdate AS started_at FROM lineitem),
  infra AS (SELECT substr(sha256('infra:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey), 1, 32) AS uid,
    CASE WHEN l_returnflag <> 'N' THEN (l_partkey % 10)::INT END AS service_id, l_shipdate AS applied_at, 'part-' || l_partkey AS resource_name FROM lineitem)"""
