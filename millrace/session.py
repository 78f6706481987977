"""Session builder with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable between engines; the other settings let AQE re-plan skewed and small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Get or create a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
