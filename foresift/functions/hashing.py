"""Hashed draws: deterministic, independent of partitioning, and equal in every engine that has md5."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_int(*parts) -> Column:
    """Non-negative integer below 2^32; never NULL, so that a join on it does not compute the hash twice."""
    return F.coalesce(F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def draw(n: Column, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.coalesce(F.pmod(hash_int(*parts), n), F.lit(0).cast("bigint"))
