"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew-join handling; ``conf`` adds to or overrides these."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hold Arrow batches for Python to ``rows`` rows and 16 MB, so that long texts don't fill a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
