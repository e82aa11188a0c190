"""Session settings the plans rely on, and the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed joins are split at run time even where that costs one more shuffle.
# A few shuffled records grow into many (case, record) pairs, each with all its
# tokens, and a task's memory is some 60 times what it reads: partitions are
# merged up to a few MB only, and files are read in small pieces.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.files.maxPartitionBytes": "16m",
}

# Shuffles start with a partition for every so many bytes of a query's tables,
# so that those partitions stay small however large the tables are.
BYTES_PER_PARTITION = 1 << 20
MAX_PARTITIONS = 10_000

# A side of a join is broadcast by its estimated size up to here only. Estimates
# come from files: ids as text in a task's hash table take some 20 times as much.
BROADCAST_BYTES = 1 << 20

# Spark's estimate for rows it knows nothing about is above this.
UNKNOWN_BYTES = 1 << 60


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # A session that broadcasts less, or nothing, keeps its own bound.
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST_BYTES:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    return spark


def fit_partitions(*tables: DataFrame) -> int:
    """Let shuffles start with as many partitions as the tables' files ask for;
    adaptive execution merges those that turn out small. Never fewer than the
    session has."""
    spark = tables[0].sparkSession
    size = sum(_leaf_bytes(df) for df in tables)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    known = [spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(key, None) or 0]
    n = max(min(size // BYTES_PER_PARTITION, MAX_PARTITIONS), *map(int, known))
    spark.conf.set(key, str(n))
    return n


def _leaf_bytes(df: DataFrame) -> int:
    """Bytes of the tables a plan reads, where Spark knows them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < UNKNOWN_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir`` (or has set as
    checkpoint folder)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def with_default_folder(spark: SparkSession) -> SparkSession:
    """Where the cluster names no folder, take one in the warehouse, which
    executors share as well."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_discard_at_exit, spark, folder)
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted when the driver's
    Python ends, or earlier with :func:`discard`."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_discard_at_exit, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _discard_at_exit(spark: SparkSession, path: str) -> None:
    """A stopped session can delete nothing any more."""
    if spark.sparkContext._jsc is not None:
        discard(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, of which readers
    take the columns they need; deleted when the driver's Python ends."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's rows in bytes: from file sizes and the
    columns read, an upper bound where rows are filtered."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
