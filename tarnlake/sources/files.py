"""Small files of a folder in any store that Hadoop's file systems reach."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def at(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def exists(self, *names: str) -> bool:
        return self.fs.exists(self.path(*names))

    def names(self, *names: str) -> list[str]:
        """What lies in a folder, in order; nothing if there is none."""
        path = self.path(*names)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def size(self, *names: str) -> int:
        return self.fs.getContentSummary(self.path(*names)).getLength()

    def age(self, *names: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self.path(*names)).getModificationTime() / 1000

    def read(self, *names: str) -> str:
        stream = self.fs.open(self.path(*names))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *names: str) -> bool:
        """Writes a new file; False if there is one already, which stays."""
        path = self.path(*names)
        if self.fs.exists(path):
            return False
        try:
            stream = self.fs.create(path, False)
        except Exception as e:  # the store says that another writer came first
            if "AlreadyExists" in str(e) or isinstance(e, PySparkException):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)
