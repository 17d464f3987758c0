"""Session factory and the shared scratch folder that long jobs cut their lineage with."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    # How much larger rows are in memory than in compressed Parquet, about; measured between 3 and 10.
    "spark.sql.sources.fileCompressionFactor": "8.0",
    # Streams with keyed state need it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides single settings (dots as ``__``)."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh temporary one is set only where none is set and all tasks run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="evidentry-scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/evidentry/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in this application's part of the scratch folder."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables this application materialized, once no result is read any more."""
    _delete(spark, _own_scratch(spark))


#: Rows of an Arrow batch while a table is written: batches of long texts stand in memory on both sides of a Python worker.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared scratch folder as Parquet and returns a scan of it.

    Unlike a cache it survives lost executors, costs no executor memory, and gives the
    planner sizes, so that joins above it broadcast only what Spark's threshold allows. Files
    are smaller than rows in memory: :func:`build_session` has the planner reckon with eight
    times their size, and a session made otherwise keeps its own setting. Only the size of Arrow
    batches is set while the table is written, and set back.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table written by :func:`materialize` that no later plan reads."""
    spark = df.sparkSession
    plain = lambda path: path.split(":", 1)[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if plain(folder).startswith(plain(_own_scratch(spark)) + "/"):
            _delete(spark, folder)
