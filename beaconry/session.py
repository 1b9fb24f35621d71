"""Session with the settings the jobs are written for."""

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName("beaconry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture makes building large plans slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
