"""Portable hashed draws.

``hash32(parts...)`` = first 8 hex digits of ``md5(concat_ws('|', parts))`` as an
integer; ``hash_u`` scales it to [0, 1). The value depends only on the row's
own fields, never on row order or partitioning, and DuckDB can repeat it with
``('0x' || substr(md5(x), 1, 8))::BIGINT``. This replaces the reference's
order-dependent random streams (seeded shuffles, sampling, weighted choice).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _part(p) -> Column:
    if isinstance(p, Column):
        return F.coalesce(p.cast("string"), F.lit(""))
    return F.lit(str(p))


def hash_key(*parts) -> Column:
    """The string that gets hashed: parts joined by '|' (nulls as '')."""
    return F.concat_ws("|", *[_part(p) for p in parts])


def hash_hex(n_digits: int, *parts) -> Column:
    """First ``n_digits`` hex digits of the md5 of the joined parts, as bigint."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, n_digits), 16, 10).cast("bigint")


def hash32(*parts) -> Column:
    return hash_hex(8, *parts)


def hash_u(*parts) -> Column:
    """Uniform draw in [0, 1) keyed by the parts."""
    return hash32(*parts) / F.lit(TWO_POW_32)


def sql_hash32(*parts: str) -> str:
    """DuckDB form of :func:`hash32` for oracle SQL; parts are SQL expressions."""
    inner = ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"


def sql_hash_hex(n_digits: int, *parts: str) -> str:
    inner = ", ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, {n_digits}))::BIGINT"


def sql_hash_u(*parts: str) -> str:
    return f"({sql_hash32(*parts)} / 4294967296.0)"
