"""Which version of a folder's contents is the current one."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Pointer:
    """Empty files ``_versions/<number>-<version>``; the one with the highest number names the current version.

    Moving on creates one file, which file systems and object stores do at once: there is no moment without a current
    version, and a run that fails before it leaves the old one. Files of older versions are deleted afterwards.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = f"{folder}/_versions"
        self._fs = self._path(self._at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(self._at)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def current(self) -> str | None:
        names = self._names()
        return names[-1].split("-", 1)[1] if names else None

    def move(self, version: str) -> None:
        names = self._names()
        number = int(names[-1].split("-", 1)[0]) + 1 if names else 0
        self._fs.mkdirs(self._path(self._at))
        if not self._fs.createNewFile(self._path(f"{self._at}/{number:012d}-{version}")):
            raise OSError(f"version {number} is there already")
        for name in names:
            self._fs.delete(self._path(f"{self._at}/{name}"), False)

    def write(self, path: str, text: str) -> None:
        f = self._fs.create(self._path(path), True)
        f.write(bytearray(text.encode()))
        f.close()

    def read(self, path: str) -> str:
        f = self._fs.open(self._path(path))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()
