"""Ordered computations inside a trial that never need a whole trial in one task.

A trial can hold a third of all rows, so ``row_number() over (partition by trial)`` and
friends would put that third into one task. Every ordered operator here works in two levels:

1. rows are grouped into *blocks* that follow the order (time slices, hash prefixes or sort
   ranges) and the window function runs inside ``(key, block)``;
2. one small row per block is aggregated, and a second window over those rows gives each
   block what came before it (or after it).

Results equal the one-level window exactly, for any block length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import cut

BLK = "__blk"
AT = "__at"  # key and block as one value: NULL keys and NULL blocks are values like any other


@dataclass(frozen=True)
class Axis:
    """Partition keys, total order and the block expression that follows that order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: str

    @property
    def ts(self) -> str:
        return self.order[0]

    def blocked(self, df: DataFrame) -> DataFrame:
        return df.withColumn(AT, F.struct(*self.keys, F.expr(self.block).alias(BLK)))

    def local(self) -> Window:
        return Window.partitionBy(AT).orderBy(*self.order)

    def whole(self) -> Window:
        """All blocks of a key, over a frame with one row per block."""
        return Window.partitionBy(*[F.col(AT)[k] for k in self.keys])

    def blocks(self) -> Window:
        return self.whole().orderBy(F.col(AT)[BLK])


def time_axis(key: str = "trial_id", ts: str = "t_s", tie: tuple[str, ...] = ("sample_id",),
              block: float = 600.0) -> Axis:
    """Axis over time with slices of ``block`` time units."""
    return Axis((key,), (ts, *tie), f"cast(floor(`{ts}` / {float(block)!r}) as bigint)")


def hash_axis(keys: tuple[str, ...], hash_col: str, tie: str, digits: int = 3) -> Axis:
    """Axis over an md5 order; blocks are hash prefixes, hence equal in size."""
    return Axis(keys, (hash_col, tie), f"substr(`{hash_col}`, 1, {digits})")


def fit_digits(n: int, rows: int = 250_000) -> int:
    """Hex digits of a hash prefix for about ``rows`` rows per block."""
    return max(1, math.ceil(math.log(max(1, n / rows), 16)))


def fit_block(df: DataFrame, key: str, ts: str, unit: float, rows: int = 250_000) -> float:
    """Block length for which the densest trial holds about ``rows`` rows per block.

    One pruned aggregate over (key, time unit); a single number reaches the driver.
    """
    dense = (df.groupBy(key, F.floor(F.col(ts) / F.lit(float(unit))).alias("u")).count()
             .agg(F.max("count")).first()[0])
    return unit * max(1e-6, rows / max(1, dense or 1))


def sorted_axis(df: DataFrame, order: list[str]) -> tuple[DataFrame, Axis]:
    """Range-sort a frame over a global order and use the sort ranges as blocks.

    The sorted frame is checkpointed, because both levels must see the same ranges even
    when an executor is lost. ``order`` must be unique per row.
    """
    ranged = cut(df.orderBy(*order).withColumn(BLK + "_r", F.spark_partition_id()))
    return ranged, Axis((), tuple(order), BLK + "_r")


def positions(df: DataFrame, axis: Axis, out: str = "pos") -> DataFrame:
    """0-based row number inside the key."""
    return running(df, axis, {out: ("rows", F.lit(1))}).withColumn(out, F.col(out) - 1)


def running(df: DataFrame, axis: Axis, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates from the first row of the key up to and including each row.

    Kinds: ``rows``/``sum``, ``max``, ``min``, ``last`` (last non-null value) and ``total``
    (sum over the whole key).
    """
    b = axis.blocked(df)
    upto = axis.local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = axis.blocks().rowsBetween(Window.unboundedPreceding, -1)
    whole = axis.whole()

    per_block, carry, here, final = [], [], [], []
    for i, (name, (kind, e)) in enumerate(aggs.items()):
        p, c, h = f"__p{i}", f"__c{i}", f"__h{i}"
        if kind in ("sum", "rows", "total"):
            per_block.append(F.sum(e).alias(p))
            if kind == "total":
                carry.append(F.coalesce(F.sum(p).over(whole), F.lit(0)).alias(c))
                final.append(F.col(c).alias(name))
                continue
            carry.append(F.sum(p).over(before).alias(c))
            here.append((F.row_number().over(axis.local()) if kind == "rows" else F.sum(e).over(upto)).alias(h))
            final.append((F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(h), F.lit(0))).alias(name))
        elif kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            per_block.append(fn(e).alias(p))
            carry.append(fn(p).over(before).alias(c))
            here.append(fn(e).over(upto).alias(h))
            final.append(pick(F.col(c), F.col(h)).alias(name))
        elif kind == "last":
            tail = F.max(F.when(e.isNotNull(), F.struct(*axis.order, e.alias("v"))))
            per_block.append(tail["v"].alias(p))
            carry.append(F.last(p, ignorenulls=True).over(before).alias(c))
            here.append(F.last(e, ignorenulls=True).over(upto).alias(h))
            final.append(F.coalesce(F.col(h), F.col(c)).alias(name))
        else:
            raise ValueError(f"unknown running aggregate: {kind}")

    carried = b.groupBy(AT).agg(*per_block).select(AT, *carry)
    kept = [f"`{c}`" for c in df.columns if c not in aggs]
    return b.select("*", *here).join(carried, AT, "left").select(*kept, *final)


def neighbours(df: DataFrame, axis: Axis, cols: list[str], before: int = 1, after: int = 0) -> DataFrame:
    """The rows around each row: columns ``__prev{i}_{field}`` and ``__next{i}_{field}``.

    Fields are the order columns and ``cols``, ``i`` = 1 is the nearest row; all are NULL beyond
    the ends of a trial. Inside a block this is lag/lead; at a block's edge the rows come from a
    per-block carry of its first and last few rows.
    """
    fields = list(dict.fromkeys([*axis.order, *cols]))
    held = [*fields, "__is"]  # a row is there even if its time is NULL
    row, asc, wb = F.struct(*held), axis.local(), axis.blocks()
    b = axis.blocked(df).withColumn("__is", F.lit(True))

    # a row is among the first n of its block iff there is none n rows before it
    one = F.lit(1)
    head = F.lag(one, after).over(asc).isNull() if after else F.lit(False)
    tail = F.lead(one, before).over(asc).isNull() if before else F.lit(False)
    edge = (b.select(AT, *held).withColumns({"__head": head, "__tail": tail})
            .where("__head or __tail").groupBy(AT)
            .agg(F.array_sort(F.collect_list(F.when(F.col("__tail"), row))).alias("__t"),
                 F.array_sort(F.collect_list(F.when(F.col("__head"), row))).alias("__h")))
    carry = []
    if before:
        carry.append(F.reverse(F.flatten(F.collect_list("__t").over(wb.rowsBetween(-before, -1)))).alias("__cp"))
    if after:
        carry.append(F.flatten(F.collect_list("__h").over(wb.rowsBetween(1, after))).alias("__cn"))
    sides = [("prev", F.lag, "__cp", before), ("next", F.lead, "__cn", after)]
    local = [fn(f, i).over(asc).alias(f"__{side}{i}_{f}") for side, fn, _, n in sides for i in range(1, n + 1)
             for f in held]
    out = b.select("*", *local).join(edge.select(AT, *carry), AT, "left")

    def near(side: str, carried: str, i: int, f: str) -> Column:
        here = lambda j: F.col(f"__{side}{j}___is").isNotNull()
        inside = sum((here(j).cast("int") for j in range(1, i)), F.lit(0))
        return F.when(here(i), F.col(f"__{side}{i}_{f}")).otherwise(
            F.get(F.col(carried), F.lit(i - 1) - inside)[f]).alias(f"__{side}{i}_{f}")

    return out.select(*[f"`{c}`" for c in df.columns], *[near(side, carried, i, f) for side, _, carried, n in sides
                                     for i in range(1, n + 1) for f in fields])


def global_positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """0-based rank over a global, unique order."""
    ranged, axis = sorted_axis(df, order)
    return positions(ranged, axis, out).drop(BLK + "_r")
