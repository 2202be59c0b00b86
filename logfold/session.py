"""Spark session with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "logfold", **conf: str) -> SparkSession:
    """A session; on a cluster pass master and leave shuffle partitions to AQE by giving a high count."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
