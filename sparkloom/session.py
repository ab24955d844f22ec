"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results don't depend on these but for the time zone; partition counts are left to the cluster's own settings.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sparkloom", master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS`` and ``more``; ``master`` is for local runs."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()
