"""Tables of ids are not broadcast because their files are small."""

import pytest
from pyspark.sql import functions as F

from casefeat.session import BROADCAST_BYTES, configure
from casefeat.sources.chain import align_to_leaf, id_chain

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def threshold(spark):
    held = spark.conf.get(THRESHOLD)
    yield held
    spark.conf.set(THRESHOLD, held)


def test_ids_are_not_broadcast(spark, threshold, tmp_path):
    """Some 3 MB of files, below Spark's own 10 MB."""
    spark.conf.set(THRESHOLD, "10m")
    configure(spark)
    # Ids from a hash, which files do not make smaller.
    up = F.xxhash64("id").alias("up")
    spark.range(300_000).select(up).write.parquet(str(tmp_path / "up"))
    spark.range(300_000).select(up, F.xxhash64("id", F.lit(1)).alias("down")).write.parquet(str(tmp_path / "down"))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("up", "down")}
    size = sum(p.stat().st_size for p in (tmp_path / "up").glob("*.parquet"))
    assert BROADCAST_BYTES < size < 10 << 20
    chain = id_chain([*tables.items()])
    rows = align_to_leaf(chain, tables["up"].withColumn("n", F.lit(1)))
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 300_000


@pytest.mark.parametrize("own", ["-1", "262144"])
def test_a_session_that_broadcasts_less_keeps_its_bound(spark, threshold, own):
    spark.conf.set(THRESHOLD, own)
    configure(spark)
    assert spark.conf.get(THRESHOLD) == own
