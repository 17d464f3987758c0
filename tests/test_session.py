from __future__ import annotations

from pathlib import Path

from evidentry.session import clear_scratch, discard, materialize, scratch_dir


def test_materialized_tables(spark):
    one, two = materialize(spark.range(5), "one"), materialize(spark.range(0), "two")
    root = Path(scratch_dir(spark).removeprefix("file://"))
    folder = next((root / "evidentry").glob("*/one-*"))
    assert one.count() == 5 and two.count() == 0 and two.columns == ["id"]
    discard(one)
    assert not folder.exists()
    discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert Path("/root/testdata/sf0.001/region.parquet").exists()
    clear_scratch(spark)
    assert not folder.parent.exists()


def test_materialize_leaves_the_settings_alone(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    assert before["spark.sql.sources.fileCompressionFactor"] == "8.0"
    own = spark.newSession()
    own.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")
    materialize(own.range(3), "settings")
    materialize(spark.range(3), "settings")
    assert own.conf.get("spark.sql.sources.fileCompressionFactor") == "1.0"
    assert {k: spark.conf.get(k) for k in before} == before
