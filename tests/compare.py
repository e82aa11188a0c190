"""Compare registered queries with their SQL twins on one folder of tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[name]):
            frame[name] = frame[name].astype("datetime64[us]").astype(str)
        elif frame[name].dtype == object:
            frame[name] = frame[name].map(lambda v: None if v is None or v is pd.NaT else str(v))
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(spark_df, con, sql) -> str | None:
    """What differs, or ``None``."""
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    ours, theirs = canonical(ours), canonical(theirs)
    for name in ours.columns:
        if str(ours[name].dtype) != str(theirs[name].dtype):
            return f"column {name}: {ours[name].dtype} != {theirs[name].dtype}"
        differs = ~((ours[name] == theirs[name]) | (ours[name].isna() & theirs[name].isna()))
        if differs.any():
            where = differs.idxmax()
            return f"column {name}: {int(differs.sum())} values, first {ours.loc[where].to_dict()} != {theirs.loc[where].to_dict()}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from casefeat.catalog import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    con, sqls, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            found = difference(fn(session, sf_dir), con, sqls[name])
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - began:.2f}s {found or ''}", flush=True)
    print("differences:", bad, "without SQL:", sorted(set(queries()) - set(sqls)))
