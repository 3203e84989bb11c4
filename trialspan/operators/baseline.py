"""Baselining v0..v8 and time derivatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, two_slopes
from ..functions.sizing import attach
from ..functions.timeline import Axis, neighbours

# Baseline methods per condition filter and the names of derived columns.
METHODS = {
    "noAFE": ["v0", "v1", "v2", "v5", "v6", "v7", "v8"],
    "Complete": ["v0", "v1", "v2", "v5", "v6"],
}
DERIVATIVES = {1: "_derivative", 2: "_2derivative"}


def early_means(df: DataFrame, axis: Axis, cols: Sequence[str], window: float) -> DataFrame:
    """Per trial: mean over ``ts < window``; NULL if the window is empty or holds a NULL."""
    early = F.col(axis.ts) < F.lit(window)
    n = F.count_if(early)
    return df.groupBy(*axis.keys).agg(*[
        F.when(F.count(F.when(early, F.col(c))) == n, F.avg(F.when(early, F.col(c)))).alias(f"__early_{c}")
        for c in cols])


def _late_means(df: DataFrame, axis: Axis, cols: Sequence[str], window: float, event: str,
                marker: str) -> DataFrame:
    """Per trial: marker time and the mean over ``(T - window, T)``."""
    key = list(axis.keys)
    marks = df.where(F.col(event) == marker).groupBy(*key).agg(F.min(axis.ts).alias("__T"))
    t = F.col(axis.ts)
    late = (t > F.col("__T") - F.lit(window)) & (t < F.col("__T"))
    n = F.count_if(late)
    return attach(df, marks, key, "inner").groupBy(*key).agg(
        F.first("__T").alias("__T"),
        *[F.when(F.count(F.when(late, F.col(c))) == n, F.avg(F.when(late, F.col(c)))).alias(f"__late_{c}")
          for c in cols])


def _with_early(df, axis, cols, window):
    return attach(df, early_means(df, axis, cols, window), list(axis.keys))


def baseline(df: DataFrame, method: str, cols: Sequence[str], axis: Axis, window: float = 0.0,
             event: str = "event", marker: str | None = None, subject: str = "subject_id",
             resting: DataFrame | None = None, bands: DataFrame | None = None,
             band_of: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Add ``{col}_{method}`` for every column.

    ``resting``: (subject, ``resting``). ``bands``: (subject, ``channel``, ``band``, ``value``) with
    ``band_of`` naming the (channel, band) of each column.
    """
    out = lambda c: f"{c}_{method}"
    if method == "v0":
        return df.select("*", *[F.col(c).alias(out(c)) for c in cols])
    if method in ("v1", "v2"):
        joined = _with_early(df, axis, cols, window)
        if method == "v1":
            exprs = [_div_guarded(c).alias(out(c)) for c in cols]
        else:
            exprs = [(F.col(c) - F.coalesce(F.col(f"__early_{c}"), F.lit(0.0))).alias(out(c)) for c in cols]
        return joined.select(*df.columns, *exprs)
    if method in ("v3", "v4"):
        joined = attach(_with_early(df, axis, cols, window),
                        _late_means(df, axis, cols, window, event, marker), list(axis.keys))
        second = F.col("__T").isNotNull() & (F.col(axis.ts) >= F.col("__T") - F.lit(window))
        exprs = []
        for c in cols:
            base = F.when(second, F.col(f"__late_{c}")).otherwise(F.col(f"__early_{c}"))
            exprs.append((ratio(F.col(c), base) if method == "v3" else F.col(c) - base).alias(out(c)))
        return joined.select(*df.columns, *exprs)
    if method in ("v5", "v6"):
        joined = attach(df, resting.select(subject, F.col("resting").alias("__rest")), [subject])
        rest = F.col("__rest")
        exprs = [(ratio(F.col(c), F.coalesce(rest, F.lit(1.0))) if method == "v5"
                  else F.col(c) - F.coalesce(rest, F.lit(0.0))).alias(out(c)) for c in cols]
        return joined.select(*df.columns, *exprs)
    if method in ("v7", "v8"):
        wide = band_columns(bands, subject, [band_of[c] for c in cols])
        joined = attach(df, wide, [subject])
        exprs = []
        for c in cols:
            base = F.col(_band_name(*band_of[c]))
            value = ratio(F.col(c), base) if method == "v7" else F.col(c) - base
            exprs.append(F.when(base == 0, F.lit(0.0)).otherwise(value).alias(out(c)))
        return joined.select(*df.columns, *exprs)
    raise ValueError(f"unknown baseline method: {method}")


def _div_guarded(c: str) -> Column:
    mean = F.col(f"__early_{c}")
    return F.col(c) / F.when(mean.isNull() | (mean == 0), F.lit(1.0)).otherwise(mean)


def _band_name(channel: str, band: str) -> str:
    return f"__band_{channel}_{band}"


def band_columns(bands: DataFrame, subject: str, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per subject, one column per wanted (channel, band)."""
    return bands.groupBy(subject).agg(*[
        F.max(F.when((F.col("channel") == ch) & (F.col("band") == b), F.col("value"))).alias(_band_name(ch, b))
        for ch, b in dict.fromkeys(wanted)])


def gradient(df: DataFrame, axis: Axis, cols: Sequence[str], order: int = 1) -> DataFrame:
    """Add first (and second) time derivatives, from one lag/lead pass.

    The second derivative is the gradient of the first, so it needs two rows on either side.
    """
    near, ts = neighbours(df, axis, list(cols), before=order, after=order), axis.ts

    def at(i: int, c: str) -> Column:
        name = c if i == 0 else f"__prev{-i}_{c}" if i < 0 else f"__next{i}_{c}"
        return F.col(name).cast("double")

    # step i lies between the rows i - 1 and i
    steps, points = range(1 - order, order + 1), range(1 - order, order)
    gaps = near.select("*", *[(at(i, ts) - at(i - 1, ts)).alias(f"__h{i}") for i in steps])
    slopes = gaps.select("*", *[ratio(at(i, c) - at(i - 1, c), F.col(f"__h{i}")).alias(f"__s{i}_{k}")
                                for i in steps for k, c in enumerate(cols)])
    firsts = slopes.select("*", *[
        two_slopes(F.col(f"__h{i}"), F.col(f"__s{i}_{k}"), F.col(f"__h{i + 1}"), F.col(f"__s{i + 1}_{k}"))
        .alias(f"__d{i}_{k}") for i in points for k, _ in enumerate(cols)])
    out = [F.col(f"__d0_{k}").alias(c + DERIVATIVES[1]) for k, c in enumerate(cols)]
    if order == 2:
        step = lambda i, k: ratio(F.col(f"__d{i}_{k}") - F.col(f"__d{i - 1}_{k}"), F.col(f"__h{i}"))
        out += [two_slopes(F.col("__h0"), step(0, k), F.col("__h1"), step(1, k)).alias(c + DERIVATIVES[2])
                for k, c in enumerate(cols)]
    return firsts.select(*df.columns, *out)


def combine_baselines(df: DataFrame, axis: Axis, plan: Mapping[str, Sequence[str]], derivatives: bool = True,
                      **sides) -> DataFrame:
    """All methods side by side, each with its two derivatives.

    ``plan`` maps a method to its columns; the wide row keeps the method order.
    """
    out, names = df, []
    for method, cols in plan.items():
        out = baseline(out, method, cols, axis, **sides)
        names += [f"{c}_{method}" for c in cols]
    return gradient(out, axis, names, order=2) if derivatives else out
