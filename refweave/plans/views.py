"""The domain tables in the form that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.functions.normalize import norm_id, norm_path
from refweave.operators.liveness import symbol_states
from refweave.sources import crawl
from refweave.sources.tables import table

EXTRA = ("name", "kind", "end_line", "update_id", "pos_x", "pos_y")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """(relative_path, updated_at): the latest time of each path."""
    t = table(spark, sf, "code_files")
    return t.select(norm_path("relative_path").alias("relative_path"), "updated_at").where("relative_path is not null").groupBy("relative_path").agg(F.max("updated_at").alias("updated_at"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """(relative_path, updated_at) of the last delivered snapshot."""
    t = table(spark, sf, "code_file_snapshots").select("snapshot_no", norm_path("relative_path").alias("relative_path"), "updated_at").where("relative_path is not null")
    last = t.agg(F.max("snapshot_no").alias("snapshot_no"))
    return t.join(F.broadcast(last), "snapshot_no").groupBy("relative_path").agg(F.max("updated_at").alias("updated_at"))


def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(relative_path, line_count): the most lines of a path's texts."""
    t = crawl.line_counts(table(spark, sf, "file_texts")).select(norm_path("relative_path").alias("relative_path"), "line_count")
    return t.where("relative_path is not null").groupBy("relative_path").agg(F.max("line_count").alias("line_count"))


def live_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The current rows of live symbols."""
    return symbol_states(table(spark, sf, "symbols"), table(spark, sf, "symbol_removals"), EXTRA).where("live").drop("live", "has_row", "removed", "at", "first_at")


def current_references(spark: SparkSession, sf: str) -> DataFrame:
    """(id, from_symbol_id, to_symbol_id, from_path, to_path, reference_type, line_number, indexed_at): current rows."""
    t = table(spark, sf, "symbol_references")
    v = F.struct("indexed_at", norm_id("from_symbol_id").alias("from_symbol_id"), norm_id("to_symbol_id").alias("to_symbol_id"), norm_path("from_path").alias("from_path"), norm_path("to_path").alias("to_path"), "reference_type", "line_number")
    got = t.where("id is not null").select("id", v.alias("v")).groupBy("id").agg(F.max("v").alias("v"))
    return got.select("id", "v.from_symbol_id", "v.to_symbol_id", "v.from_path", "v.to_path", "v.reference_type", "v.line_number", "v.indexed_at")
