"""SparkSession factory with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "textloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Builds or returns a session: UTC, AQE with skew-join splitting, Arrow on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: spark-submit
    and AQE decide.  Locally pass ``master="local[8]", shuffle_partitions=8``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
