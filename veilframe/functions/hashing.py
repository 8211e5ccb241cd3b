"""Randomness that depends on a row's key alone: the same on any partitioning and in any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
TOP = 1 << 32


def draw(seed: int, purpose: str, *key: Column | str) -> Column:
    """Uniform whole number in [0, TOP) for (seed, purpose, key)."""
    parts = [F.lit(f"{seed}|{purpose}")] + [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("~")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def below(seed: int, purpose: str, p: float, *key: Column | str) -> Column:
    """True with probability p."""
    return draw(seed, purpose, *key) < F.lit(int(p * TOP))
