"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "wordloom", **settings: str) -> SparkSession:
    """A SparkSession with adaptive execution; `settings` use double underscores for dots (spark__sql__...)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf.update({k.replace("__", "."): v for k, v in settings.items()})
    return builder.config(map=conf).getOrCreate()
