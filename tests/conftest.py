import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from casefeat import GrainColumn, RecordSource, Tokens  # noqa: E402
from casefeat.operators.vocab import build_vocab, calendar_vocab  # noqa: E402
from casefeat.session import configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("casefeat-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def cases(spark):
    rows = [("c1", "p1", ts("2024-01-02")), ("c2", "p2", ts("2024-01-02"))]
    return spark.createDataFrame(rows, "case_id string, pid string, pred_dt timestamp_ntz")


@pytest.fixture(scope="session")
def record_df(spark):
    rows = [
        ("p1", "r1", ts("2024-01-01 00:00:00"), "a"),
        ("p1", "r2", ts("2024-01-01 06:00:00"), "a"),
        ("p1", "r3", ts("2024-01-01 23:56:00"), "b"),
        ("p1", "r4", ts("2024-01-02 00:00:00"), "b"),
        ("p1", "r5", ts("2024-01-02 00:10:00"), "a"),
    ]
    return spark.createDataFrame(rows, "pid string, rec_id string, DT_s timestamp_ntz, token string")


@pytest.fixture(scope="session")
def source(record_df):
    return RecordSource("Rec", record_df)


@pytest.fixture(scope="session")
def tok_table(spark):
    return spark.createDataFrame(
        [("a", "Tok", 0), ("b", "Tok", 1)], "grn string, rfg string, pos bigint"
    )


@pytest.fixture(scope="session")
def vocab(spark, tok_table):
    return build_vocab([tok_table, calendar_vocab(spark, 2024, 2024, "Cal")])


@pytest.fixture(scope="session")
def tokens(vocab):
    from pyspark.sql import functions as F

    return Tokens("Tok", [GrainColumn("Tok", lambda: F.array("token"))], vocab=vocab)
