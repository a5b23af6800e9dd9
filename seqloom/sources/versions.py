"""Tables in numbered versions: readers keep the version that they opened, and of two writers that began with one version the second is refused.

A version is a folder of its own that nothing changes any more. It counts once its
number stands in the manifest, as a file that can be created only once; a writer
that died before leaves a folder that no reader looks at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Versions:
    """The versions of one table below ``path``, in any file system of Spark's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file_system(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def numbers(self) -> list[int]:
        fs, target = self._file_system(f"{self.path}/manifest")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(target)) if fs.exists(target) else []

    def latest(self) -> int:
        """The number of the latest version, 0 if there is none."""
        return max(self.numbers(), default=0)

    def folder(self, version: int) -> str:
        fs, target = self._file_system(f"{self.path}/manifest/{version}")
        if not fs.exists(target):
            raise ValueError(f"{self.path} has no version {version}")
        stream = fs.open(target)
        try:
            return f"{self.path}/data/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the latest if none is named; later commits don't change what is read."""
        return self.spark.read.parquet(self.folder(version or self.latest()))

    def commit(self, table: DataFrame, base: int) -> int:
        """Writes ``table`` as the version after ``base`` and returns its number.

        If a version after ``base`` exists by then, nothing changes and Conflict is
        raised: what was inserted meanwhile isn't lost by a rebuild that didn't see it.
        """
        if self.latest() != base:
            raise Conflict(f"{self.path} is at version {self.latest()}, not {base}")
        name = uuid.uuid4().hex
        table.write.parquet(f"{self.path}/data/{name}")
        fs, target = self._file_system(f"{self.path}/manifest/{base + 1}")
        try:
            stream = fs.create(target, False)  # only one writer can
        except Exception as e:
            if not fs.exists(target):
                raise
            raise Conflict(f"{self.path} has a version {base + 1} already") from e
        stream.writeUTF(name)
        stream.close()
        return base + 1

    def drop_before(self, version: int) -> None:
        """Deletes older versions; readers that have one open must be done."""
        for n in [n for n in self.numbers() if n < version]:
            for path in (self.folder(n), f"{self.path}/manifest/{n}"):
                fs, target = self._file_system(path)
                fs.delete(target, True)
