"""Reproducible random numbers: a uniform number that depends on nothing but the values it is made from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 hash that make a number.
DIGITS = 10


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the MD5 hash of the parts, which any SQL engine has."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def uniform_sql(*parts: str) -> str:
    """:func:`uniform` in DuckDB SQL."""
    return f"(CAST('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, {DIGITS}) AS BIGINT) / {float(16**DIGITS)!r})"
