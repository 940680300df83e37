"""Columns that bring identifiers and paths to the one spelling used in results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that surrounds identifiers, and braces (fixed values).
EDGE = " \t\n\r\f\x0b                 　﻿{}"


def norm_id(c: Column | str) -> Column:
    """Identifier without surrounding white space and braces, in lower case; blank gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(EDGE))), F.lit(""))


def norm_path(c: Column | str) -> Column:
    """Path with slashes and without a leading ``./``; blank gives null."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    p = F.when(p.startswith("./"), F.substring(p, 3, 2147483647)).otherwise(p)
    return F.when(F.btrim(p) != "", p)


_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _word(hexa: Column, at: int) -> Column:
    return F.conv(F.substring(hexa, at, 8), 16, 10).cast("bigint")


def _signed(hexa: Column, at: int) -> Column:
    return (_word(hexa, at) - F.lit(2147483648)) * F.lit(4294967296) + _word(hexa, at + 8)


def int_key(identifier: Column) -> tuple[Column, Column, Column]:
    """(space, hi, lo): a 128-bit integer in two signed longs whose order is the integer's order.

    A canonical UUID is its own integer (space 0); any other identifier is numbered by its MD5 (space 1).
    """
    plain = identifier.rlike(_UUID)
    h = F.when(plain, F.replace(identifier, F.lit("-"), F.lit(""))).otherwise(F.md5(identifier))
    return F.when(plain, F.lit(0)).otherwise(F.lit(1)).cast("int"), _signed(h, 1), _signed(h, 17)
