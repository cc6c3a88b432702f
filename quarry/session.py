"""Session settings this library expects; nothing here is needed if the caller brings a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quarry", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC times, adaptive plans and skew handling; settings use _ for . in names."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (wanted | {k.replace("_", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
