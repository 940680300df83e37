"""Catalogue kept up by a stream of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from refweave.operators import catalog
from refweave.schema import CODE_FILES
from refweave.sources.store import Store


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert every new parquet file of (relative_path, updated_at) below ``folder`` into the store's code_files, then stop.

    Of a path's rows within a batch the latest time counts. A batch that is run again after a failure gives the same
    catalogue.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = catalog.one_per_path(batch, "relative_path", "updated_at")
        store.publish({"code_files": catalog.upsert(store.table("code_files"), rows, "relative_path")})

    stream = spark.readStream.schema(CODE_FILES).parquet(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
