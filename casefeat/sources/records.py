"""Record tables: projection, id and time columns, storage groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RecordSource
from ..functions.hashing import entity_group
from ..session import fit_partitions


def time_column(df: DataFrame) -> str:
    """The first column whose name contains ``DT``."""
    found = next((c for c in df.columns if "DT" in c), None)
    if found is None:
        raise ValueError(f"no time column among {df.columns}")
    return found


def load_records(source: RecordSource) -> DataFrame:
    """Records as ``pid, rec_id, dt`` and the asked-for columns."""
    df = source.df
    dt = source.dt or time_column(df)
    keys = {"pid": source.pid, "rec_id": source.rec_id}
    wanted = df.columns if source.columns == "ALL" else source.columns
    rest = [c for c in wanted if c in df.columns and c not in (*keys.values(), dt)]
    ids = {name: F.col(c).cast("string") if source.text_ids else F.col(c) for name, c in keys.items()}
    fit_partitions(df)
    return df.select(*[c.alias(name) for name, c in ids.items()], F.col(dt).alias("dt"), *rest)


def write_by_group(rows: DataFrame, path: str, order: Sequence[str], bloom: Sequence[str] = ()) -> None:
    """Write rows with a ``grp`` column, one folder per group. Rebalancing
    gathers small groups and splits crowded ones into several files by size;
    rows are sorted for row-group skipping. Columns in ``bloom`` get a Bloom
    filter per row group, as large as their values need."""
    placed = rows.hint("rebalance", F.col("grp")).sortWithinPartitions("grp", *order)
    writer = placed.write.mode("errorifexists").option("parquet.bloom.filter.adaptive.enabled", "true")
    for name in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy("grp").parquet(path)


def write_grouped(
    records: DataFrame, path: str, range_size: int | None = None, groups: int = 64
) -> None:
    """Write records in storage groups of entities."""
    grp = entity_group(F.col("pid"), range_size, groups)
    write_by_group(records.withColumn("grp", grp), path, ["pid", "dt"])


def read_grouped(spark: SparkSession, path: str, groups: Sequence[int] | None = None) -> DataFrame:
    """Records of the named groups (all when none are named); only their
    folders are opened. A group without a folder has no rows."""
    df = spark.read.parquet(path)
    return df if groups is None else df.where(F.col("grp").isin(list(groups)))


def union_records(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts as one table; a column missing from a part is null there."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union
