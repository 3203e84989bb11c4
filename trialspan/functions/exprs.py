"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SEED = 42


def hash_key(*cols: str | Column, seed: int | str = HASH_SEED) -> Column:
    """Pseudo-random, reproducible sort key: md5 of ``seed:value[:value...]``."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_uniform(h: Column) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits (52 bits) of an md5."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """Division that yields NULL (or a given value) instead of failing on zero."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def nan_to_null(c: Column) -> Column:
    """Missing values are NULL inside the library; NaN only exists outside."""
    return F.when(~F.isnan(c), c)


def two_slopes(h0: Column, s0: Column, h1: Column, s1: Column) -> Column:
    """Second-order derivative on an uneven axis from the slopes before and after a row.

    The inner formula is the distance-weighted mean of both slopes; a NULL distance means an end
    of the trial, where the one slope there is counts.
    """
    return F.when(h0.isNull(), s1).when(h1.isNull(), s0).otherwise(ratio(h1 * s0 + h0 * s1, h0 + h1))


def any_null(cols: list[str]) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.col(c).isNull()
    return cond
