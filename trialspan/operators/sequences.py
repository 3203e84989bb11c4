"""Fixed-length sequence windows over rows, and forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeline import Axis, positions, running


def sequence_windows(df: DataFrame, axis: Axis, cols: Sequence[str], label: str, length: int, step: int,
                     horizon: int = 0, end_label: bool = True) -> DataFrame:
    """Windows of ``length`` rows every ``step`` rows inside a trial.

    Row p belongs to the windows that start at multiples of ``step`` in (p - length, p], so the
    windows are built by grouping on (trial, start); no trial is ordered in one task. The label
    is that of the row ``horizon`` after the end, or the list over all rows.
    """
    keys = list(axis.keys)
    placed = positions(df, axis, "__pos")
    reach = length + horizon
    first = F.greatest(F.ceil((F.col("__pos") - (reach - 1)) / F.lit(float(step))).cast("bigint"),
                       F.lit(0).cast("bigint"))
    last = F.floor(F.col("__pos") / F.lit(float(step))).cast("bigint")
    each = (placed.withColumns({"__w0": first, "__w1": last}).where("__w0 <= __w1")
            .select(*keys, "__pos", *cols, F.col(label).alias("__y"),
                    F.explode(F.expr("sequence(__w0, __w1)")).alias("window"))
            .withColumn("__at", F.col("__pos") - F.col("window") * step))
    inside = F.col("__at") < length
    row = F.struct("__at", *[F.col(c) for c in cols])
    aggs = [F.sort_array(F.collect_list(F.when(inside, row))).alias("__rows"),
            F.max("__at").alias("__max")]
    if end_label:
        aggs.append(F.max(F.when(F.col("__at") == reach - 1, F.col("__y"))).alias("label"))
    else:
        shifted = (F.col("__at") >= horizon) & (F.col("__at") < reach)
        aggs.append(F.transform(F.sort_array(F.collect_list(F.when(shifted, F.struct("__at", "__y")))),
                                lambda r: r["__y"]).alias("label"))
    out = each.groupBy(*keys, "window").agg(*aggs).where(F.col("__max") == reach - 1)
    return out.select(*keys, (F.col("window") * step).alias("start"),
                      F.transform("__rows", lambda r: F.array(*[r[c] for c in cols])).alias("rows"), "label")


def window_mean_summary(windows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean over each sequence window, one column per feature (NULLs skipped)."""
    def mean(i: int):
        vals = F.filter(F.transform("rows", lambda r: F.get(r, i)), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(vals, F.lit(0.0), lambda a, v: a + v.cast("double")),
                            F.size(vals).cast("double"))
    return windows.select(*keys, "start", "label", *[mean(i).alias(c) for i, c in enumerate(cols)])


def flatten_windows(windows: DataFrame, out: str = "features") -> DataFrame:
    """The whole window as one ML vector."""
    from pyspark.ml.functions import array_to_vector

    flat = F.transform(F.flatten("rows"), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    return windows.withColumn(out, array_to_vector(flat))


def ffill(df: DataFrame, axis: Axis, cols: Sequence[str], leftover: float = 0.0) -> DataFrame:
    """Carry the last value of the trial forward; what is still missing becomes ``leftover``."""
    filled = running(df, axis, {f"__f_{c}": ("last", F.col(c)) for c in cols})
    return filled.withColumns({c: F.coalesce(F.col(f"__f_{c}"), F.lit(leftover)) for c in cols}).select(*df.columns)
