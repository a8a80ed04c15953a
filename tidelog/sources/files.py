"""The few file operations that Spark's readers and writers do not offer, on any store that Spark can open."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidelog.model import Conflict


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def aged(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder, with the time of their last change in seconds."""
        if not self.exists(folder):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path(folder)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """Write a new file; Conflict if it exists. Only one of several writers can create it."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as error:
            if self.exists(name):
                raise Conflict(f"{name} is already there") from error
            raise
        stream.write(bytearray(data))
        stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
