"""Seeded draws as Column expressions, the same on every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 15
SPAN = 16**DIGITS


def md5_long(*parts: Column | str | int) -> Column:
    """First 60 bits of ``md5(part:part:..)`` as a non-negative bigint."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint")


def md5_draw(bound: Column, *parts: Column | str | int) -> Column:
    """A draw from ``0 .. bound-1``."""
    return F.pmod(md5_long(*parts), bound)
