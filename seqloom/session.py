"""Spark session defaults for tests, benches and notebooks; on a cluster the submitted settings win."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seqloom") -> SparkSession:
    """A local session in UTC with AQE on. Memory comes from SEQLOOM_DRIVER_MEMORY (default 8g)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SEQLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_code(spark: SparkSession) -> SparkSession:
    """Let this session's Python workers import the package, if nobody told them yet.

    Local workers see the driver's folder; those of a cluster get a copy from the
    driver, once a context.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if context.master.startswith("local"):
        env = context.environment
        told = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in told:
            env["PYTHONPATH"] = os.pathsep.join([*told, root])
    elif not getattr(context, "_seqloom_shipped", False):
        name = os.path.join(tempfile.mkdtemp(), "seqloom_code")
        context.addPyFile(shutil.make_archive(name, "zip", root, "seqloom"))
        context._seqloom_shipped = True
    return spark
