import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from moodtide.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=4,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.autoBroadcastJoinThreshold": "10MB"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def values(spark):
    """Evaluate a column function on a list of texts."""

    def run(function, texts):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
        out = rows.select("i", function(F.col("t")).alias("v")).collect()
        return [row["v"] for row in sorted(out, key=lambda row: row["i"])]

    return run
