import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def fresh_dir():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture
def files(spark):
    """Builds files(file_id, path, content) from texts."""

    def build(*texts):
        rows = [(n, f"src/{n}.c", text) for n, text in enumerate(texts)]
        return spark.createDataFrame(rows, "file_id bigint, path string, content string")

    return build
