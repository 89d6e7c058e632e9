"""Shuffle files that go when the query that wrote them ends, not only when the driver collects its garbage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries in here delete the files of their shuffles when they end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
