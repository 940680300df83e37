"""Scalar functions of the code model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from refweave.schema import FILE, KIND_NAMES


def basename(path: Column) -> Column:
    """The part after the last slash; the path itself where that is empty."""
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), path)


def label(kind: Column, name: Column, path: Column) -> Column:
    """A file is labelled by its base name, other symbols by their name."""
    return F.when(kind == FILE, basename(path)).otherwise(name)


def below(path: Column, root: str | None) -> Column:
    """``path`` relative to the folder ``root``, with slashes; unchanged outside of it or without a root."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if not root:
        return p
    r = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(r), F.substring(p, len(r) + 1, 2147483647)).otherwise(p)


def relative(path: Column, root: str | None) -> Column:
    """``path`` as seen from the folder ``root``, with slashes and as many ``..`` as it takes; unchanged without a root or
    where it isn't absolute."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    if not root:
        return path
    base = root.replace("\\", "/").rstrip("/").split("/")
    part, at = F.split(F.when(p == "/", "").otherwise(F.rtrim(p, F.lit("/"))), "/"), F.array(*map(F.lit, base))
    common = F.size(F.filter(F.sequence(F.lit(1), F.lit(len(base))), lambda n: F.slice(part, 1, n) == F.slice(at, 1, n)))
    steps = F.concat(F.array_repeat(F.lit(".."), F.lit(len(base)) - common), F.slice(part, common + 1, F.lit(2147483647)))
    return F.when(p.rlike("^(/|[A-Za-z]:/)"), F.concat_ws("/", steps)).otherwise(path)


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def position(x: Column, y: Column) -> Column:
    """struct<x, y>, or null unless both are set."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def iso_time(ts: Column) -> Column:
    """UTC time with milliseconds, as ``2024-01-02T03:04:05.678Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def pad2(c: Column) -> Column:
    """At least two characters, filled with zeros on the left; longer ones stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= 2, s).otherwise(F.lpad(s, 2, "0"))


def kind_name(kind: Column) -> Column:
    """Name of a kind's number; ``Unknown`` for others."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, KIND_NAMES)), (F.when(kind.between(0, len(KIND_NAMES) - 1), kind) + 1).cast("int")), F.lit("Unknown"))


def stable_id(*parts: Column) -> Column:
    """A reproducible id of the parts; null parts differ from empty ones."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in (x.cast("string") for x in parts)]), 256)


def message(key: Column, base: dict[str, str], overlay: dict[str, str] | None = None) -> Column:
    """The text of a message key: from the overlay, else the base; the key where that is empty or absent."""
    table = {**base, **(overlay or {})}
    found = reduce(lambda rest, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(rest), table.items(), F.lit(None).cast("string"))
    return F.coalesce(F.nullif(found, F.lit("")), key)
