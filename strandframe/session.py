"""Session settings that suit the operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandframe", **more: str) -> SparkSession:
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
