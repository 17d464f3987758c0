"""Every citation of a summary must be one that a query returned."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentry.functions import citations

CITE_KEYS = ("cite", "source_cites", "baseline_cites", "resolution_cite")


def unsupported(cites: DataFrame, captured: DataFrame) -> DataFrame:
    """Citations that no captured result has, with whether they are well formed. Empty for a sound summary."""
    return cites.select("cite").distinct().join(captured.select("cite"), "cite", "left_anti").withColumn("well_formed", citations.well_formed(F.col("cite")))


def captured_cites(results: DataFrame, *columns: str, by: str | None = None) -> DataFrame:
    """The distinct citations of result columns, single or arrays; with ``by``, those of each of its values beside it."""
    kinds = dict(results.dtypes)
    arrays = [F.col(c) if kinds[c].startswith("array") else F.array(c) for c in columns]
    flat = F.array_distinct(F.array_compact(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))
    return results.select(*([by] if by else []), F.explode(flat).alias("cite")).distinct()


def first_captures(trace: DataFrame) -> DataFrame:
    """(cite, event): where a citation was captured first; ``trace`` has (event, cites)."""
    return trace.select("event", F.explode("cites").alias("cite")).groupBy("cite").agg(F.min("event").alias("event"))


def harvest(value: Any) -> Iterator[str]:
    """All citations in a nested response on the driver."""
    if isinstance(value, Mapping):
        for key, item in value.items():
            if key in CITE_KEYS:
                yield from [item] if isinstance(item, str) else item or ()
            else:
                yield from harvest(item)
    elif isinstance(value, list | tuple):
        for item in value:
            yield from harvest(item)


def replay_digest(tables: Mapping[str, DataFrame], skip: tuple[str, ...] = ("id", "created_at", "updated_at", "exemplar_id")) -> str:
    """One hash of all rows of all tables, whatever their order and partitioning.

    Rows are hashed where they are; the hashes are summed by table as exact decimals, so that
    only one row a table reaches the driver and repeated rows still count.
    """
    import hashlib

    lines = []
    for name, table in sorted(tables.items()):
        columns = sorted(c for c in table.columns if c not in skip)
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        halves = [F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16, 31)]
        found = table.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*"), *[F.sum(f"h{i}") for i in range(3)]).first()
        lines.append(f"{name}:{':'.join(str(x or 0) for x in found)}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
