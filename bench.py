"""Time the headline queries; prints one JSON line.

Every query is run once to warm up (JIT, file listing) and once for the
figure; both are reported. The result is written to Spark's no-op sink, so
the whole plan runs and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from casefeat.catalog import queries  # noqa: E402

HEADLINE = [
    "compress_mean_day",
    "compress_two_level",
    "compress_sum_hour",
    "compress_cat",
    "observe_before_24h",
    "observe_bucketed",
    "observe_hot_cells",
    "recnum_before",
    "recnum_every_record",
    "recnum_joined",
    "threshold_dtind",
    "threshold_chain",
    "token_rows_with_unk",
    "one_tkn_in_5min",
    "encode_ids",
    "nested_layers",
    "multi_feature",
    "store_incremental",
    "case_filter_dev",
    "split_sets",
    "id_chain_prefix",
    "records_per_entity",
    "vocab_build",
    "batch_export",
]


def timed(spark, fn, sf_dir) -> float:
    began = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, names = queries(), sys.argv[1:] or HEADLINE
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(timed(spark, known[name], sf_dir), 3)
        warm[name] = round(timed(spark, known[name], sf_dir), 3)
    cases = known["trigger_cases"](spark, sf_dir).count()
    flagship = warm.get("compress_mean_day")
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "flagship_cases_per_sec": round(cases / flagship) if flagship else None,
                "cpus": cpus,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
