"""Visual encodings of graph nodes and edges, as columns. A count of zero or null counts as one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_one(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; null counts as 0."""
    return F.coalesce((F.length(F.encode(c, "UTF-16BE")) / 2).cast("int"), F.lit(0))


def node_width(label: Column, n: Column) -> Column:
    return F.greatest(F.lit(140), utf16_length(label) * 9 + or_one(n) * 3).cast("bigint")


def node_height(n: Column) -> Column:
    return F.greatest(F.lit(70), F.lit(50) + or_one(n) * 3).cast("bigint")


def text_width(label: Column) -> Column:
    return F.greatest(F.lit(100), utf16_length(label) * 8).cast("bigint")


def node_repulsion(n: Column) -> Column:
    return (F.lit(150000) + or_one(n) * 8000).cast("bigint")


def edge_width(r: Column) -> Column:
    return F.least(F.greatest(or_one(r) * F.lit(0.8), F.lit(1.0)), F.lit(10.0))


def edge_colour(r: Column) -> Column:
    """``rgb(R, G, B)`` from blue to red as the count nears ten."""
    i = F.least(or_one(r) / F.lit(10.0), F.lit(1.0))
    red, green, blue = F.floor(F.lit(71) + i * 160), F.floor(F.lit(144) - i * 68), F.floor(F.lit(226) - i * 166)
    return F.format_string("rgb(%d, %d, %d)", red, green, blue)


def edge_opacity(r: Column) -> Column:
    return F.least(F.lit(0.6) + or_one(r) * F.lit(0.04), F.lit(1.0))


def edge_length(r: Column) -> Column:
    return F.greatest(F.lit(250), F.lit(450) - or_one(r) * 15).cast("bigint")


def edge_elasticity(r: Column) -> Column:
    return (F.lit(80) + or_one(r) * 15).cast("bigint")
