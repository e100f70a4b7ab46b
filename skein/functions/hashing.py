"""Deterministic, partition-independent random choices.

Every random choice in the library is ``bucket(salt, key, n)``: the first eight
hex digits of ``md5(salt || ':' || key)`` read as an integer, modulo ``n``. The
same number comes out of Spark and of the SQL oracle, on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex8(salt: str, key) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def bucket(salt: str, key, n) -> Column:
    """Integer in [0, n) chosen by md5 of ``salt:key``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(_hex8(salt, key), n.cast("bigint"))


def unit_interval(salt: str, key) -> Column:
    """Double in [0, 1) chosen by md5 of ``salt:key``."""
    return _hex8(salt, key) / F.lit(4294967296.0)


def sql_bucket(salt: str, key_sql: str, n) -> str:
    """The same choice written for the SQL oracle."""
    return f"((('0x' || substr(md5('{salt}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT) % ({n}))"


def sql_unit_interval(salt: str, key_sql: str) -> str:
    return f"((('0x' || substr(md5('{salt}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT) / 4294967296.0)"
