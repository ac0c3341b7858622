"""Session defaults: adaptive execution, UTC, Arrow transfers."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str, *, cores: int | str = "*", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session with the defaults; on a cluster the submitter's settings win."""
    session = SparkSession.builder.appName(name).master(f"local[{cores}]").config(map=DEFAULTS | (extra or {})).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
