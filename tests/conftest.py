"""One local session for all tests, with the repository on the workers' path."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as tmp:
        session = (
            SparkSession.builder.master("local[4]").appName("tests")
            .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
            .config("spark.checkpoint.dir", f"file://{tmp}/checkpoint").config("spark.sql.warehouse.dir", f"{tmp}/warehouse")
            .getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
