"""Positions to the innermost symbol that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a bucket: spans and positions meet only within a path's bucket.
BUCKET = 64
LINE_END = 2**31 - 1


def or_default(df: DataFrame, column: str, default: int) -> Column:
    """The column, or ``default`` where it is null or the table has none."""
    return F.coalesce(F.col(column), F.lit(default)).cast("int") if column in df.columns else F.lit(default)


def innermost(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, char, symbol_id): for each distinct position the symbol reached by going down from the roots.

    At each level the first child (by ordinal) that holds the position is taken, without going back; positions that no root
    holds have no row. positions: (path, line, char). spans: (path, id, parent_id or null, depth, ordinal, start_line,
    start_char, end_line, end_char), both ends included. The characters may be missing: a position without one is at the
    line's begin, a span without them goes from the begin of its first line to the end of its last.
    A position of null path or line has no row. Positions are made distinct first, so hot ones are one row.
    """
    p = positions.select("path", "line", or_default(positions, "char", 0).alias("char")).where("path is not null and line is not null").distinct().withColumn("bucket", F.floor(F.col("line") / BUCKET))
    s = spans.withColumns({"start_char": or_default(spans, "start_char", 0), "end_char": or_default(spans, "end_char", LINE_END)})
    s = s.where("start_line < end_line or start_line = end_line and start_char <= end_char").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))))
    within = "(line > start_line or line = start_line and char >= start_char) and (line < end_line or line = end_line and char <= end_char)"
    holds = p.join(s, ["path", "bucket"]).where(within)
    # only spans that hold one position meet in a group: its nesting and its overlapping siblings
    chain = F.array_sort(F.collect_list(F.struct("depth", "ordinal", "id", "parent_id")))
    start = F.struct(F.lit(None).cast("string").alias("id"), F.lit(-1).alias("depth"))
    step = F.aggregate(
        "chain", start,
        lambda acc, x: F.when((x["depth"] == acc["depth"] + 1) & (acc["id"].eqNullSafe(x["parent_id"])), F.struct(x["id"].alias("id"), x["depth"].cast("int").alias("depth"))).otherwise(acc),
    )
    got = holds.groupBy("path", "line", "char").agg(chain.alias("chain")).select("path", "line", "char", step["id"].alias("symbol_id"))
    return got.where(F.col("symbol_id").isNotNull())
