"""Current rows and liveness of identified records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.normalize import norm_id, norm_path


def symbol_states(symbols: DataFrame, removals: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, parent_id, path, start_line, at, first_at, has_row, removed, live) per identifier of either table.

    ``extra`` names further columns of symbols to take from the current row.

    live: it has a row and no removal at or after the time of its current row. A removal without a time removes
    nothing, but counts as known to the removals. One shuffle on the identifier, combined map-side.
    """
    v = F.struct(
        F.col("indexed_at").alias("at"), F.lit(True).alias("has_row"), norm_id("parent_id").alias("parent_id"),
        norm_path("path").alias("path"), F.col("start_line").alias("start_line"), *[F.col(c).alias(c) for c in extra],
    )
    rows = symbols.select(norm_id("id").alias("id"), v.alias("v"), F.col("indexed_at").alias("seen"), F.lit(None).cast("timestamp_ntz").alias("gone"), F.lit(False).alias("removed"))
    none = F.lit(None).cast(rows.schema["v"].dataType)
    gone = removals.select(norm_id("symbol_id").alias("id"), none.alias("v"), F.lit(None).cast("timestamp_ntz").alias("seen"), F.col("removed_at").alias("gone"), F.lit(True).alias("removed"))
    agg = (
        rows.unionByName(gone).where(F.col("id").isNotNull()).groupBy("id")
        .agg(F.max("v").alias("v"), F.min("seen").alias("first_at"), F.max("gone").alias("gone"), F.max("removed").alias("removed"))
    )
    has = F.col("v").isNotNull()
    dead = F.col("gone").isNotNull() & (F.col("v.at").isNull() | (F.col("gone") >= F.col("v.at")))
    return agg.select(
        "id", "v.parent_id", "v.path", "v.start_line", *[f"v.{c}" for c in extra], "v.at", "first_at", has.alias("has_row"), "removed", (has & ~dead).alias("live")
    )


def symbol_liveness(symbols: DataFrame, removals: DataFrame) -> DataFrame:
    """(id, live, first_at, removed) as in :func:`symbol_states`, with fixed-width aggregates only."""
    none = F.lit(None).cast("timestamp_ntz")
    rows = symbols.select(norm_id("id").alias("id"), F.col("indexed_at").alias("seen"), none.alias("gone"), F.lit(1).alias("r"), F.lit(0).alias("d"))
    gone = removals.select(norm_id("symbol_id").alias("id"), none.alias("seen"), F.col("removed_at").alias("gone"), F.lit(0).alias("r"), F.lit(1).alias("d"))
    agg = (
        rows.unionByName(gone).where(F.col("id").isNotNull()).groupBy("id")
        .agg(F.max("seen").alias("at"), F.min("seen").alias("first_at"), F.max("gone").alias("gone"), F.max("r").alias("r"), F.max("d").alias("d"))
    )
    dead = F.col("gone").isNotNull() & (F.col("at").isNull() | (F.col("gone") >= F.col("at")))
    return agg.select("id", ((F.col("r") == 1) & ~dead).alias("live"), "first_at", (F.col("d") == 1).alias("removed"))
