"""Session settings that every operator relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "hopwright", master: str | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``extra`` overrides settings (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and the bench."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    base = {"spark__sql__shuffle__partitions": str(cores), "spark__ui__enabled": "false", "spark__driver__memory": "12g"}
    return build_session(master=f"local[{cores}]", **(base | extra))
