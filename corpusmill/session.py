"""Session settings that the package expects; nothing here is needed on a cluster that sets its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", name: str = "corpusmill", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, few shuffle partitions."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("CORPUSMILL_DRIVER_MEMORY", "8g"),
    }
    settings.update(conf)
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()
