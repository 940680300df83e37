"""Versioned parquet snapshots of the stored tables: write a new version, then move the pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from refweave.schema import TABLES
from refweave.sources.pointer import Pointer


class Store:
    """A folder with one sub-folder a version and table, and a pointer to the current version.

    A version has the tables that changed with it, and a list of the folders of all. A run that fails leaves the pointer,
    so readers see the last whole version. Paths may be of any file system that Hadoop knows. A closed store, also by the
    end of a ``with`` block, is not read or written any more.
    """

    def __init__(self, spark: SparkSession, folder: str, create: bool = True) -> None:
        self.spark, self.folder, self._closed = spark, folder.rstrip("/"), False
        self._pointer = Pointer(spark, self.folder)
        if not self.exists():
            if not create:
                raise FileNotFoundError(f"no store at {folder}")
            self.publish({name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._closed = True

    def exists(self) -> bool:
        return self._pointer.current() is not None

    def version(self) -> str:
        return self._pointer.current() or ""

    def _folders(self) -> dict[str, str]:
        if self._closed:
            raise ValueError("the store is closed")
        return json.loads(self._pointer.read(f"{self.folder}/{v}/tables.json")) if (v := self._pointer.current()) else {}

    def table(self, name: str) -> DataFrame:
        """The current version of a table."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{self._folders()[name]}")

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write the tables, then make them current; those not given stay as and where they are."""
        version, folders = uuid.uuid4().hex, self._folders()
        for name, df in tables.items():
            cols = [df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else _null(f) for f in TABLES[name]]
            out = df.select(*cols)
            folders[name] = f"{version}/{name}"
            # files of one path together, so that lookups by path skip row groups
            out.sortWithinPartitions(out.columns[0] if name == "code_files" else "path" if name == "symbols" else "from_path").write.parquet(f"{self.folder}/{folders[name]}")
        self._pointer.write(f"{self.folder}/{version}/tables.json", json.dumps(folders))
        self._pointer.move(version)
        return version


def _null(field: object) -> object:
    from pyspark.sql import functions as F

    return F.lit(None).cast(field.dataType).alias(field.name)
