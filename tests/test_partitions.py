"""Tasks stay small however large the tables are."""

import pytest
from pyspark.sql import functions as F

from casefeat import session
from casefeat.config import RecordSource
from casefeat.session import configure, fit_partitions
from casefeat.sources.chain import id_chain
from casefeat.sources.records import load_records

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture(autouse=True)
def initial(spark):
    spark.conf.unset(INITIAL)
    yield
    spark.conf.unset(INITIAL)


def test_merged_and_read_in_small_pieces(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_partitions_follow_the_files(spark, monkeypatch, tmp_path):
    spark.range(50_000).select(F.col("id").alias("a"), F.xxhash64("id").alias("x")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", size // 50)
    assert fit_partitions(table) in (50, 51)
    assert spark.conf.get(INITIAL) in ("50", "51")
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", size)
    # Never fewer than before, and all of a query's tables count.
    assert fit_partitions(table) in (50, 51)
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", size // 50)
    assert fit_partitions(table, table) in (100, 101)
    monkeypatch.setattr(session, "MAX_PARTITIONS", 120)
    assert fit_partitions(table, table, table) == 120


def test_rows_of_unknown_size_do_not_count(spark):
    rows = spark.createDataFrame([("p", "r", 1)], "pid string, rec_id string, DT long")
    load_records(RecordSource("R", rows))
    assert spark.conf.get(INITIAL) == spark.conf.get("spark.sql.shuffle.partitions")


def test_chains_and_records_fit_them(spark, monkeypatch, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("up"), F.xxhash64("id").alias("down"), F.current_timestamp().alias("DT"))
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "BYTES_PER_PARTITION", 10_000)
    load_records(RecordSource("R", table, "up", "down", "DT"))
    n = int(spark.conf.get(INITIAL))
    assert n > 10
    id_chain([("up", table), ("down", table)])
    assert int(spark.conf.get(INITIAL)) >= 2 * n
