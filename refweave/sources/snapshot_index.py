"""The key-to-hash index of the last snapshot, kept between runs: bucketed tables, probed by the next and swapped."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.session import cut
from refweave.sources.pointer import Pointer


class SnapshotIndex:
    """Two tables in one folder: path to hash, bucketed by path, and path to time, in a folder a bucket. A pointer names the
    current version.

    A probe reads the hashes only, and as they are bucketed, only the new rows are shuffled. The times of the last snapshot
    are fetched for the paths whose hash differs, from those of their buckets alone. A run that fails before the pointer
    has moved leaves the old index.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._pointer = Pointer(spark, self.folder)

    def version(self) -> str | None:
        return self._pointer.current()

    def _bucket(self) -> Column:
        return F.pmod(F.hash("relative_path"), F.lit(self.buckets))

    def _hashes(self, version: str | None) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], "relative_path string, hash long")
        name = f"refweave_hashes_{version}"
        self.spark.sql(
            f"CREATE TABLE {name} (relative_path STRING, hash BIGINT) USING parquet "
            f"CLUSTERED BY (relative_path) SORTED BY (relative_path) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{version}/hashes'"
        )
        got = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the entry in the catalogue; the files stay
        return got

    def _times(self, version: str | None, hit: DataFrame) -> DataFrame:
        """(relative_path, old_ms) of the buckets in which ``hit`` changed or removed a path: as many numbers as buckets at most."""
        schema = "relative_path string, old_ms long"
        if not version:
            return self.spark.createDataFrame([], schema)
        touched = [r[0] for r in hit.where("change_kind <> 'added'").select(self._bucket()).distinct().collect()]
        return self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{version}/times").where(F.col("bucket").isin(touched)).drop("bucket")

    def changes(self, latest: DataFrame) -> DataFrame:
        """(relative_path, change_kind, old_ms, new_ms) of (relative_path, updated_ms) against the index.

        latest has one row a path. Without an index yet all paths are ``added``.
        """
        v = self.version()
        new = latest.select("relative_path", F.col("updated_ms").alias("new_ms"), F.xxhash64("updated_ms").alias("new_hash"), F.lit(True).alias("is_new"))
        probed = new.join(self._hashes(v).withColumn("is_old", F.lit(True)), "relative_path", "full_outer")
        kind = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").when(F.col("hash") != F.col("new_hash"), "changed")
        hit = cut(probed.select("relative_path", kind.alias("change_kind"), "new_ms").where(F.col("change_kind").isNotNull()))
        full = hit.join(self._times(v, hit), "relative_path", "left")
        return full.where((F.col("change_kind") != "changed") | ~F.col("old_ms").eqNullSafe(F.col("new_ms"))).select("relative_path", "change_kind", "old_ms", "new_ms")

    def swap(self, latest: DataFrame) -> str:
        """Make ``latest`` the snapshot that the next one is probed against."""
        version = uuid.uuid4().hex
        parts = latest.repartition(self.buckets, "relative_path")
        name = f"refweave_hashes_{version}"
        hashes = parts.select("relative_path", F.xxhash64("updated_ms").alias("hash"))
        hashes.write.bucketBy(self.buckets, "relative_path").sortBy("relative_path").option("path", f"{self.folder}/{version}/hashes").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        parts.select("relative_path", F.col("updated_ms").alias("old_ms"), self._bucket().alias("bucket")).write.partitionBy("bucket").parquet(f"{self.folder}/{version}/times")
        self._pointer.move(version)
        return version
