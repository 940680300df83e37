"""Changes to the stored tables as functions of tables, and the diff that asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.operators.skew import skew_join


def to_millis(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def one_per_path(listing: DataFrame, path: str, at: str) -> DataFrame:
    """(path, at): of a path's rows the latest time; null only where there is no other."""
    return listing.where(F.col(path).isNotNull()).groupBy(path).agg(F.max(at).alias(at))


def listing_diff(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(relative_path, action, listed_at): ``add``, ``update``, ``remove`` or ``equal`` for each path of either side.

    listing and catalogue: (relative_path, updated_at), one row a path. A path is updated when its time differs after
    cutting to milliseconds, an older time included; null equals null only.
    """
    a = listing.select("relative_path", F.col("updated_at").alias("listed_at"), F.lit(True).alias("listed"))
    b = catalogue.select("relative_path", F.col("updated_at").alias("known_at"), F.lit(True).alias("known"))
    action = (
        F.when(F.col("known").isNull(), "add").when(F.col("listed").isNull(), "remove")
        .when(to_millis(F.col("listed_at")).eqNullSafe(to_millis(F.col("known_at"))), "equal").otherwise("update")
    )
    return a.join(b, "relative_path", "full_outer").select("relative_path", action.alias("action"), "listed_at")


def removes(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(relative_path) of the catalogue that the listing lacks."""
    return catalogue.select("relative_path").join(listing.select("relative_path"), "relative_path", "left_anti")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows of ``source`` in place of its own of the same key. source has one row a key."""
    return target.join(source.select(key), key, "left_anti").unionByName(source.select(target.columns))


def replace_by_id(target: DataFrame, source: DataFrame, seq: Column, key: str = "id") -> DataFrame:
    """As :func:`upsert`; of several source rows of a key the last by ``seq`` is taken, of equal ones the greatest."""
    cols = target.columns
    last = source.select(key, F.struct(seq.alias("_seq"), *[F.col(c) for c in cols if c != key]).alias("_v")).groupBy(key).agg(F.max("_v").alias("_v"))
    rows = last.select(*[F.col(c) if c == key else F.col(f"_v.{c}").alias(c) for c in cols])
    return upsert(target, rows, key)


def delete(target: DataFrame, keys: DataFrame, column: str, key: str = "relative_path") -> DataFrame:
    """``target`` without the rows whose ``column`` is one of ``keys``; null values stay."""
    return target.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(target.columns)


def delete_references(references: DataFrame, paths: DataFrame) -> DataFrame:
    """References without those that begin or end in one of ``paths`` (relative_path): two keyed joins, no OR join."""
    return delete(delete(references, paths, "from_path"), paths, "to_path")


def delete_symbols(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    return delete(symbols, paths, "path")


def fk_violations(references: DataFrame, symbols: DataFrame, hot: DataFrame | None | bool = True) -> DataFrame:
    """(id, column, symbol_id) of each reference end whose symbol isn't there; null ends violate nothing.

    The symbols are met through :func:`skew.skew_join`, so that a hot symbol_id is no single task; ``hot`` as there.
    """
    ids = symbols.select(F.col("id").alias("symbol_id")).distinct()
    return skew_join(reference_ends(references), ids, ["symbol_id"], F.col("id"), "left_anti", hot).select("id", "column", "symbol_id")


def reference_ends(references: DataFrame) -> DataFrame:
    """(id, column, symbol_id): the set ends of each reference."""
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("symbol_id")) for c in ("from_symbol_id", "to_symbol_id")]))
    return references.select("id", ends.alias("e")).select("id", "e.column", "e.symbol_id").where(F.col("symbol_id").isNotNull())
