"""Session settings shared by the entry point, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings the operators rely on: naive timestamps are UTC, plans adapt at run time, and no generated method is
#: longer than the JVM compiles (wide projections ran three times as long).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "hourloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
