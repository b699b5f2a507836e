"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times written without a zone mean the same thing on every machine.
    "spark.sql.session.timeZone": "UTC",
    # Run-time choices: broadcast by measured size, split skewed join partitions, merge small ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Needed to read and write windows-1252 files.
    "spark.sql.legacy.javaCharsets": "true",
}


def build_session(app_name: str = "tableprep", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with :data:`SETTINGS`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def allow_java_charsets(spark: SparkSession) -> None:
    """Let this session use windows-1252; Spark 4 accepts only a few charsets otherwise."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
