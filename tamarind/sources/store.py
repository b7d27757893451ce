"""Small files and folders through Hadoop's file systems, so that they are where Spark's own tables are."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        at = self.path("")
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(at)

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist; False if it does."""
        if self.fs.exists(self.path(name)):
            return False
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if "exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
