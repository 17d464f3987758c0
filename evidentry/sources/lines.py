"""Raw lines with their byte offsets, and lines gathered into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(rows: DataFrame, group: str, block: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows of a group before each row.

    Totals are taken by block first; only they are summed across a group, so that a group of any
    size is worked on block by block. ``block`` orders the blocks of a group, ``order`` the rows.
    """
    valued = rows.withColumn(name, value)
    totals = valued.groupBy(group, *block).agg(F.sum(name).alias("block_total"))
    ahead = W.partitionBy(group).orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    before = totals.withColumn("block_before", F.coalesce(F.sum("block_total").over(ahead), F.lit(0))).drop("block_total")
    inside = W.partitionBy(group, *block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = valued.withColumn(name, F.coalesce(F.sum(name).over(inside), F.lit(0)))
    joined = summed.join(before, [group, *block])
    return joined.withColumn(name, F.col(name) + F.col("block_before")).drop("block_before")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_offset, raw): every line without its newline, a carriage return kept; ill-formed parts of UTF-8 read as U+FFFD.

    Files are read in splits, so that a large file is many tasks. A line's offset is the sum of
    the lengths before it, newlines included.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    rows = text.select(meta["file_path"].alias("source_file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    found = running_total(rows, "source_file", ["block"], ["place"], F.octet_length("raw").cast("long") + 1, "source_offset")
    return found.select("source_file", F.col("source_offset").cast("long").alias("source_offset"), F.make_valid_utf8("raw").alias("raw"))


def records_by_header(lines: DataFrame) -> DataFrame:
    """``lines`` with record: how many header lines the file has up to here; 0 before the first."""
    rows = lines.withColumn("block", F.floor(F.col("source_offset") / (1 << 24)))
    found = running_total(rows, "source_file", ["block"], ["source_offset"], F.col("is_header").cast("long"), "record")
    return found.withColumn("record", (F.col("record") + F.col("is_header").cast("long")).cast("long")).drop("block")
