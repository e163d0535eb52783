"""A session with the settings the library expects; a cluster's own settings are kept."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pagegrain", **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
