"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lumenfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the semantics here assume: ANSI arithmetic, UTC, adaptive execution, recursion without end."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "-1",
        "spark.sql.cteRecursionRowLimit": "-1",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
