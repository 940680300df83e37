"""A global order without a global task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.session import partitions, shared_table


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``row_no`` (from 1) in the given total order and ``row_count``.

    Rows are range partitioned by the order with sampled quantiles and numbered within partitions; only the sizes of
    the partitions are added up. Ties are numbered in any order. An empty table gives no rows.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = shared_table(ranged.withColumns({"row_id": F.monotonically_increasing_id()}), "numbered")
    part = F.shiftright("row_id", 33)
    sizes = [(r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect()]  # one row a partition
    before, total = [], 0
    for p, n in sorted(sizes):
        before.append((p, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "part long, before long"))
    local = F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(offsets, "part").withColumns({"row_no": F.col("before") + local + 1, "row_count": F.lit(total).cast("bigint")}).drop("row_id", "part", "before")
