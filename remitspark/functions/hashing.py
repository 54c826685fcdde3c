"""Deterministic pseudo-random columns.

The md5 of ``seed|key…`` gives the same draw on every run, retry and engine, so a task that
is computed again after a lost executor draws the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 48


def hash_long(seed: int | str, *keys: Column | str) -> Column:
    """A 48-bit integer from the seed and the keys."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]]
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_unit(seed: int | str, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return hash_long(seed, *keys) / F.lit(float(1 << HASH_BITS))


def hash_fold(n_folds: int, seed: int | str, *keys: Column | str) -> Column:
    return F.pmod(hash_long(seed, *keys), F.lit(n_folds)).cast("int")
