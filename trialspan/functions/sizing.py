"""Size checks that decide between a broadcast and a shuffled join."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

# A broadcast side is held by every executor; cells = rows x columns.
BROADCAST_CELLS = 2_000_000


def measured(dim: DataFrame, max_cells: int = BROADCAST_CELLS) -> tuple[DataFrame, bool]:
    """Persist a derived side table and tell whether it is small enough to broadcast."""
    dim = dim.persist()
    limit = max(1, max_cells // max(1, len(dim.columns)))
    return dim, dim.limit(limit + 1).count() <= limit


def attach(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
           max_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Join a per-key table to its rows.

    The side is counted first. Within the bound it is broadcast, so the large side is not
    shuffled on a key that may be skewed; beyond it, Spark's shuffled join (with adaptive
    skew splitting) is used. NULL keys are equal to each other.
    """
    dim, small = measured(dim, max_cells)
    side = dim.withColumnsRenamed({c: f"__on_{c}" for c in on})
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on])
    return df.join(F.broadcast(side) if small else side, match, how).drop(*[f"__on_{c}" for c in on])


def attach_one(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the columns of a frame that has exactly one row (a global aggregate)."""
    return df.join(F.broadcast(stats), F.lit(True), "left")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the cluster."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
