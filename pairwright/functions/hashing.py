"""Hashes that are the same on every cluster and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *parts: Column | str) -> Column:
    """Pseudo-random sort key of a row: depends on the seed and the row, not on its place."""
    filled = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *filled))
