"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "scorewright", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Adaptive execution on (partition coalescing, skewed joins), UTC, Arrow transfer.

    On a cluster leave master and partition count to spark-submit.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # everything runs in the driver; takes effect when it is the first session
            b = b.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
