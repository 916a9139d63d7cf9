"""A session with the settings these jobs want; a caller's own session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """UTC dates, AQE with skew-join splitting, no web page.

    Generated methods above 8,000 bytes are not compiled by HotSpot, so Spark is told to
    split such stages instead of interpreting them. Recording a Python call site for every
    column is turned off, as it takes longer than planning.

    Shuffle partitions are left to the cluster's setting: AQE merges small ones,
    so a large number is safe.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
