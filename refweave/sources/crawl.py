"""Listing of files by glob patterns, with their times and languages."""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType([T.StructField("relative_path", T.StringType(), False), T.StructField("updated_at", T.TimestampNTZType()), T.StructField("language_id", T.StringType())])


def glob_regex(pattern: str) -> str:
    """A regular expression, the same for Python and Java, of a glob: ``**/``, ``*``, ``?``, ``{a,b}``, ``[..]``."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, updated_at) of the files below a local folder; names with a leading dot are skipped.

    Walked by the driver: files that a distributed reader skips, with a leading underscore or empty, are listed too.
    """
    rows = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".")]
        for f in files:
            if not f.startswith("."):
                p = os.path.join(folder, f)
                at = datetime.fromtimestamp(os.stat(p).st_mtime, timezone.utc).replace(tzinfo=None)
                rows.append((os.path.relpath(p, root).replace(os.sep, "/"), at))
    return spark.createDataFrame(rows, T.StructType(LISTING.fields[:2]))


def list_remote(spark: SparkSession, root: str) -> DataFrame:
    """As :func:`walk`, by Spark's binary file source, for huge or remote trees; it skips ``_`` names and empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    base = re.escape(root.rstrip("/").split("://")[-1])
    return files.select(F.regexp_replace("path", f"^[a-z0-9]+:/*(?=/)|^[a-z0-9]+:", "").alias("p"), "modificationTime").select(
        F.regexp_replace("p", f"^.*?{base}/", "").alias("relative_path"), F.col("modificationTime").cast("timestamp_ntz").alias("updated_at")
    )


def associate(files: DataFrame, associations: dict[str, str] | None) -> DataFrame:
    """Files with the language of each pattern they match: a file that matches two patterns comes twice, one of none is left out."""
    pairs = [F.struct(F.lit(glob_regex(g)).alias("pattern"), F.lit(lang).alias("language_id")) for g, lang in (associations or {}).items()]
    if not pairs:
        return files.withColumn("language_id", F.lit(None).cast("string")).where(F.lit(False))
    return files.withColumn("a", F.explode(F.array(*pairs))).where(F.expr("relative_path rlike a.pattern")).withColumn("language_id", F.col("a.language_id")).drop("a")


def listing(spark: SparkSession, root: str, associations: dict[str, str] | None) -> DataFrame:
    return associate(walk(spark, root), associations)


def line_counts(texts: DataFrame) -> DataFrame:
    """(relative_path, line_count) of (relative_path, file_text): one more than its line breaks; 0 for a null text."""
    n = F.coalesce(F.length("file_text") - F.length(F.replace("file_text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return texts.select("relative_path", n.cast("int").alias("line_count"))


def open_texts(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, file_text) of the files below a folder, one row a file."""
    base = re.escape(root.rstrip("/").split("://")[-1])
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{base}/", "").alias("relative_path"), F.col("value").alias("file_text"))


def shortest_root(folders: list[str]) -> str | None:
    """The shortest of the workspace folders, the first of equals; None without any."""
    return min(folders, key=len) if folders else None


def workspace(spark: SparkSession, folders: list[str], associations: dict[str, str] | None) -> tuple[str, DataFrame]:
    """(root, listing) of a workspace: its shortest folder and the files there that match an association.

    Without a folder or without an association there is nothing to index, which is a ValueError rather than an empty
    listing, by which an index run would remove everything.
    """
    root = shortest_root(folders)
    if root is None or not associations:
        raise ValueError("a workspace needs a folder and an association")
    return root, listing(spark, root, associations)


def store_path(root: str) -> str:
    """Where the store of a workspace's root folder lies."""
    return f"{root.rstrip('/')}/.refweave/store"
