"""Small files and folders of any file system that Spark reads, from the driver: manifest lines, deletion."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    path: str
    name: str
    folder: bool
    modified: float  # seconds since 1970


class Files:
    """What Hadoop's file system offers below one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def list(self, folder: str) -> list[Entry]:
        """What is directly in a folder; nothing if there is no such folder."""
        if not self.exists(folder):
            return []
        found = []
        for status in self._fs.listStatus(self._path(folder)):
            name = status.getPath().getName()
            found.append(
                Entry(f"{folder.rstrip('/')}/{name}", name, status.isDirectory(), status.getModificationTime() / 1000)
            )
        return found

    def publish(self, path: str, content: str) -> None:
        """Write a file under a hidden name and rename it, so readers see all of it or nothing."""
        folder, _, name = path.rpartition("/")
        draft = self._path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._path(path)):
            self._fs.delete(draft, False)
            raise OSError(f"could not publish {path}")

    def delete(self, path: str) -> None:
        """A file, or a folder with all that is in it; nothing if it is gone already."""
        self._fs.delete(self._path(path), True)

    def delete_if_empty(self, folder: str) -> None:
        """A folder that nothing is in; one that has got a file meanwhile stays."""
        if self.exists(folder) and not self.list(folder):
            try:
                self._fs.delete(self._path(folder), False)
            except Exception as error:  # noqa: BLE001
                if "IOException" not in str(error) and "not empty" not in str(error):
                    raise
