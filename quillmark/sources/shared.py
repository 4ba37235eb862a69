"""Small files in the store that Spark reads and writes, whichever it is: written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by its Hadoop path, for the driver's own small files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """The names of its files, but for unfinished ones."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(n for f in self._fs.listStatus(self._at("")) if f.isFile() and not (n := f.getPath().getName()).startswith((".", "_")))

    def folders(self) -> list[str]:
        if not self._fs.exists(self._at("")):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at("")) if f.isDirectory())

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; one that is there already is replaced."""
        new = self._at(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(new, self._at(name)):
            self._fs.delete(self._at(name), False)
            if not self._fs.rename(new, self._at(name)):
                raise OSError(f"{self.path}/{name} can't be written")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
