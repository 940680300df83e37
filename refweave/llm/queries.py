"""The p3, p6, p7 and p8 queries. SQL can't express their operators; the tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import leak, reading, source_kind, tokenize


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    return source_kind.not_hand_written(_table(spark, sf, "code_files"), _table(spark, sf, "file_texts"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf).select("relative_path")


def p3_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode(_table(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.decode(p6_ids(spark, sf))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leak.removal_spans(_leaks(spark, sf))


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    return p7_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(_table(spark, sf, "documents"), reading.train(_table(spark, sf, "graded_texts")))


QUERIES = {f.__name__: f for f in (p3_found, p3_kinds, p6_ids, p6_decoded, p7_found, p7_spans, p7_items, p8_found)}
SQL = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
