import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of a column function over a list of texts."""

    def run(function, texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        done = rows.select("i", function(rows["t"]).alias("out")).collect()
        return [r["out"] for r in sorted(done, key=lambda r: r["i"])]

    return run


@pytest.fixture(scope="session")
def as_lines(spark):
    """Lines table from {log id: text or list of lines}."""

    def run(logs):
        rows = []
        for log_id, body in logs.items():
            lines = body.split("\n") if isinstance(body, str) else body
            rows += [(log_id, n, line) for n, line in enumerate(lines)]
        return spark.createDataFrame(rows, "log_id string, line_no long, value string").repartition(5)

    return run
