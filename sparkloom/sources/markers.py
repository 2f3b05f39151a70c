"""Small named files that come into being whole or not at all, and are never replaced.

A marker is written under a name of its own and then renamed without overwriting, so of several writers one wins
and readers never see half of it. Needs a file system with such a rename (HDFS, local disks); a bare object store
has none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Markers:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        where = self._path(self.folder)
        self._fs = where.getFileSystem(conf)
        self._fs.mkdirs(where)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(where).toUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def put(self, name: str, content: str = "") -> bool:
        """Create a marker; False if it is there already."""
        draft, final = self._path(f"{self.folder}/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        if self._fs.exists(final):
            return False
        out = self._fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            self._files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), self._options)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def get(self, name: str) -> str | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in found if not n.startswith("."))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), False)

    def remove(self, path: str) -> None:
        """Delete a folder of the same file system."""
        self._fs.delete(self._path(path), True)
