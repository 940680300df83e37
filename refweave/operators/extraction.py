"""References from what a symbol provider and a reference provider report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refweave.functions.scalars import basename, stable_id
from refweave.operators.containment import innermost, or_default
from refweave.operators.hierarchy import hierarchies
from refweave.operators.skew import skew_join
from refweave.schema import FILE
from refweave.session import cut


def file_roots(files: DataFrame) -> DataFrame:
    """A File symbol for each file: (id, parent_id, name, kind, path, start_line, end_line, update_id).

    files: (relative_path, line_count), one row a path; a null or zero count gives the one line 0.
    """
    last = F.greatest(F.coalesce("line_count", F.lit(0)) - 1, F.lit(0)).cast("int")
    path = F.col("relative_path")
    return files.select(
        stable_id(F.lit("file"), path).alias("id"), F.lit(None).cast("string").alias("parent_id"), basename(path).alias("name"), F.lit(FILE).alias("kind"),
        path.alias("path"), F.lit(0).alias("start_line"), last.alias("end_line"), F.lit("").alias("update_id"),
    )


def kept_symbols(provider: DataFrame, kinds: list[int], top: DataFrame) -> DataFrame:
    """Provider symbols whose top-level symbol is of one of ``kinds``; deeper symbols of any kind.

    top: (path, symbol_key, top_key), the top-level symbol of each.
    """
    tops = provider.where(F.col("parent_key").isNull() & F.col("kind").isin(kinds)).select("path", F.col("symbol_key").alias("top_key"))
    return provider.join(top, ["path", "symbol_key"]).join(tops, ["path", "top_key"], "left_semi").select(provider.columns)


def top_levels(provider: DataFrame) -> DataFrame:
    """(path, symbol_key, top_key, depth) of provider symbols, by their links within a file."""
    key = lambda c: F.concat("path", F.lit("\u0001"), c)
    nodes = provider.select(key(F.col("symbol_key")).alias("id"), key(F.col("parent_key")).alias("parent_id"), "path", "start_line")
    tree = hierarchies(nodes, False).where("node_depth >= 0")
    part = lambda c: F.substring_index(c, "\u0001", -1)
    return tree.select(F.substring_index("symbol_id", "\u0001", 1).alias("path"), part(F.col("symbol_id")).alias("symbol_key"), part(F.col("root_id")).alias("top_key"), F.col("node_depth").alias("depth"))


def symbol_rows(kept: DataFrame, files: DataFrame) -> DataFrame:
    """Rows for the symbols table: each file's root and its kept symbols below it."""
    roots = file_roots(files)
    own = lambda k: stable_id(F.lit("symbol"), F.col("path"), k)
    below = kept.join(files.select(F.col("relative_path").alias("path")), "path", "left_semi")
    children = below.select(
        own(F.col("symbol_key")).alias("id"), F.coalesce(F.when(F.col("parent_key").isNotNull(), own(F.col("parent_key"))), stable_id(F.lit("file"), F.col("path"))).alias("parent_id"),
        "name", "kind", "path", "start_line", "end_line", F.lit("").alias("update_id"),
    )
    return roots.unionByName(children)


def find_ids(symbols: DataFrame) -> DataFrame:
    """(path, name, start_line, symbol_id): the least id of each key; keys with a null part find nothing."""
    return symbols.where("path is not null and name is not null and start_line is not null").groupBy("path", "name", "start_line").agg(F.min("id").alias("symbol_id"))


def located(provider: DataFrame, locations: DataFrame, depths: DataFrame) -> DataFrame:
    """Locations in other files with the innermost provider symbol there: (decl_path, decl_key, target_path, line, char, name, start_line).

    A location that no symbol holds is left out. Symbols are tried in the provider's order, by line and character; a
    location without a character is at the line's begin. Each distinct position is resolved once, and a hot one goes back
    to its locations salted.
    """
    cross = cut(locations.withColumn("char", or_default(locations, "char", 0)).where(F.col("decl_path") != F.col("target_path")))
    chars = [c for c in ("start_char", "end_char") if c in provider.columns]
    spans = provider.join(depths.select("path", "symbol_key", "depth"), ["path", "symbol_key"]).select(
        "path", F.col("symbol_key").alias("id"), F.col("parent_key").alias("parent_id"), "depth", "ordinal", "start_line", "end_line", *chars
    )
    at = innermost(cross.select(F.col("target_path").alias("path"), "line", "char"), spans)
    named = at.join(provider.select("path", F.col("symbol_key").alias("symbol_id"), "name", "start_line"), ["path", "symbol_id"])
    named = named.select(F.col("path").alias("target_path"), "line", "char", "name", "start_line")
    return skew_join(cross, named, ["target_path", "line", "char"], F.struct("decl_path", "decl_key")).select("decl_path", "decl_key", "target_path", "line", "char", "name", "start_line")


def reference_rows(located_: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for symbol_references, locations whose symbol the store doesn't have).

    from is the File symbol of the declaring file, to the innermost symbol at the usage, by path, name and start line. Two
    usages on one line, at different characters, are two rows; a location that is given twice is one. Symbols are looked up
    once a distinct (path, name, start line).
    """
    ids = find_ids(symbols).withColumnRenamed("path", "target_path")
    roots = symbols.where(F.col("kind") == FILE).groupBy("path").agg(F.min("id").alias("from_symbol_id")).withColumnRenamed("path", "decl_path")
    keys = ["target_path", "name", "start_line"]
    located_ = cut(located_)
    found = cut(skew_join(located_, ids, keys, F.struct("decl_path", "decl_key", "line", "char"), "left"))
    rows = skew_join(found.where(F.col("symbol_id").isNotNull()), roots, ["decl_path"], F.struct("target_path", "line", "char")).select(
        stable_id(F.col("decl_path"), F.col("decl_key"), F.col("target_path"), F.col("line"), F.col("char")).alias("id"), "from_symbol_id", F.col("symbol_id").alias("to_symbol_id"),
        F.col("decl_path").alias("from_path"), F.col("target_path").alias("to_path"), F.lit("reference").alias("reference_type"), F.col("line").alias("line_number"),
    )
    return rows.dropDuplicates(["id"]), found.where(F.col("symbol_id").isNull()).select(located_.columns)
