"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost executor
costs a re-read and never a recomputation of the whole job. The folder is
``spark.checkpoint.dir``; only where that is unset in local mode (tests) a folder
of our own is used and set, since no other machine could read it.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used when the session names no shared folder.
OWN_FOLDER = "/tmp/checkpoints/seqloom"

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or our own folder where it is unset in local mode; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{OWN_FOLDER}"
        os.makedirs(OWN_FOLDER, exist_ok=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends if nobody removes it before."""
    path = f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Works for empty tables too."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(*tables: DataFrame | str) -> None:
    """Delete tables made by :func:`store` (or paths) that nothing reads any more."""
    for x in tables:
        path = x if isinstance(x, str) else getattr(x, "_seqloom_path", None)
        for entry in [e for e in _left if e[1] == path]:
            _left.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_left() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
