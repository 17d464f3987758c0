"""What a service's logs did in a window, against the window before: series, anomalies, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentry.functions import citations
from evidentry.functions.times import Window
from evidentry.operators.rollups import is_kind, richness

IDENTITY = ("status_class", "level", "template_hash")


def rollups_in(rollups: DataFrame, services: DataFrame, service: str, window: Window) -> DataFrame:
    """The service's rollups of the window and of the equally long one before, read once, with is_current and cite."""
    both = Window(window.before().start, window.end)
    named = services.where(F.col("name") == service).select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    rows = rollups.where(both.holds(F.col("bucket_start"))).join(named, "service_id")
    cite = citations.rollup(F.col("service"), F.col("bucket_start"), *map(F.col, IDENTITY))
    return rows.withColumn("is_current", F.col("bucket_start") >= F.lit(window.start)).withColumn("cite", cite)


def series(rows: DataFrame) -> DataFrame:
    """Counts of the current window by bucket and status class, with their rollups' citations."""
    return _counted(rows, "bucket_start", "status_class")


def status_breakdown(rows: DataFrame) -> DataFrame:
    return _counted(rows, "status_class")


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where("is_current").groupBy(*keys).agg(F.sum("count").alias("count"), F.sort_array(F.collect_list("cite")).alias("source_cites"))


def baseline_sparse(rows: DataFrame, threshold: int = 50) -> DataFrame:
    total = F.coalesce(F.sum(F.when(~F.col("is_current"), F.col("count"))), F.lit(0))
    return rows.agg((total < threshold).alias("baseline_sparse"))


def with_exemplars(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Each rollup with the event that stands for it."""
    found = events.select(F.col("id").alias("exemplar_id"), "uid", "ts", "trace_id", "attrs", "message", "raw")
    return rows.join(found, "exemplar_id")


def top_frame(attrs: Column) -> Column:
    """The frame an event names itself, else the first well-typed one of its stack."""
    frame = "struct<file:string,line:int,func:string>"
    typed = lambda key: is_kind(attrs, f"{key}.file", "string") & is_kind(attrs, f"{key}.line", "number") & is_kind(attrs, f"{key}.func", "string")
    direct = F.when(typed("top_frame"), F.try_variant_get(F.try_parse_json(attrs), "$.top_frame", frame))
    stack = F.try_variant_get(F.try_parse_json(attrs), "$.stack", f"array<{frame}>")
    good = F.filter(stack, lambda f: f["file"].isNotNull() & f["line"].isNotNull() & f["func"].isNotNull())
    return F.coalesce(direct, F.try_element_at(good, F.lit(1)))


def _typed(attrs: Column, key: str, kind: str, to: str) -> Column:
    return F.when(is_kind(attrs, key, kind), F.try_variant_get(F.try_parse_json(attrs), f"$.{key}", to))


def exemplar(prefix: str = "") -> Column:
    c = lambda name: F.col(prefix + name)
    return F.struct(
        citations.log(c("uid")).alias("cite"),
        c("message").alias("sample_message"),
        c("raw").alias("sample_raw"),
        _typed(c("attrs"), "exc_type", "string", "string").alias("exc_type"),
        top_frame(c("attrs")).alias("top_frame"),
        _typed(c("attrs"), "upstream", "string", "string").alias("upstream"),
        _typed(c("attrs"), "duration_ms", "number", "double").alias("duration_ms"),
        c("trace_id").alias("trace_id"),
    )


def anomalies(rows: DataFrame) -> DataFrame:
    """Current and baseline counts of each identity in one conditional aggregate, with the richest exemplar.

    ``rows`` have exemplars. The exemplar is the richest one, then the smallest uid, of the
    current window's where that has any, else of the baseline's.
    """
    now, before = F.col("is_current"), ~F.col("is_current")
    rank = F.struct(before.alias("late"), (-richness(F.col("trace_id"), F.col("attrs"))).alias("poor"), F.col("uid"))
    body = F.struct("uid", "ts", "trace_id", "attrs", "message", "raw")
    out = rows.groupBy(*IDENTITY).agg(
        F.coalesce(F.sum(F.when(now, F.col("count"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(before, F.col("count"))), F.lit(0)).alias("baseline_count"),
        F.sort_array(F.collect_list(F.when(now, F.col("cite")))).alias("source_cites"),
        F.sort_array(F.collect_list(F.when(before, F.col("cite")))).alias("baseline_cites"),
        F.min_by(body, rank).alias("best"),
    )
    return out.withColumn("delta", F.col("count") - F.col("baseline_count")).withColumn("exemplar", exemplar("best.")).drop("best")


def occurrence_counts(events: DataFrame, service_id: Column | int, window: Window) -> DataFrame:
    """Occurrences that cluster events report of themselves, by template and level, in one pass; null where none does."""
    own = events.where((F.col("service_id") == service_id) & window.holds(F.col("ts")))
    counts = is_kind(F.col("attrs"), "occurrence_count", "number") & (F.try_variant_get(F.try_parse_json("attrs"), "$.source", "string") == "k8s")
    value = F.try_variant_get(F.try_parse_json("attrs"), "$.occurrence_count", "bigint")
    return own.groupBy("template_hash", "level").agg(F.sum(F.when(counts, value)).alias("occurrence_count"))


def is_error() -> Column:
    return (F.col("status_class") == "5xx") | F.col("level").isin("error", "fatal")


def top_templates(found: DataFrame, top_n: int = 10) -> DataFrame:
    """The ``top_n`` of the error pool and of the other pool, each by delta, count, template, status and level."""
    order = [F.desc("delta"), F.desc("count"), F.asc("template_hash"), F.asc("status_class"), F.asc("level")]
    ranked = found.withColumn("is_error", is_error())
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("is_error").orderBy(*order)))
    return ranked.where(F.col("rank") <= top_n)


def sample_traces(rows: DataFrame, most: int = 5) -> DataFrame:
    """The first distinct trace ids among the current window's exemplars, by time, then uid."""
    seen = rows.where(F.col("is_current") & (F.col("trace_id") != ""))
    return seen.groupBy("trace_id").agg(F.min(F.struct("ts", "uid")).alias("first")).orderBy("first").limit(most).select("trace_id", F.col("first.ts").alias("ts"), F.col("first.uid").alias("uid"))
