"""Session settings the panel operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # dates are calendar days in UTC
    "spark.sql.legacy.parquet.nanosAsLong": "true",  # nanosecond timestamps load as BIGINT
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "tessera", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k: v for k, v in conf.items()})
    return builder.getOrCreate()
