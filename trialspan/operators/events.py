"""Event marks, interval labels and label shifts, all by running counts over blocked trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import attach
from ..functions.timeline import Axis, positions, running


def _hits(event: str, value: str) -> Column:
    return F.when(F.col(event) == value, 1).otherwise(0)


def label_intervals(df: DataFrame, axis: Axis, onset: str, recovery: str, event: str = "event",
                    out: str = "label") -> DataFrame:
    """Rows from the k-th onset up to (not including) the k-th recovery of a trial are 1.

    With o and c the onsets and recoveries seen so far and R all recoveries of the trial, the
    open pairs at a row are k in (c, min(o, R)]; the row is inside iff that range is not empty.
    """
    counted = running(df, axis, {
        "__o": ("sum", _hits(event, onset)), "__c": ("sum", _hits(event, recovery)),
        "__r": ("total", _hits(event, recovery))})
    inside = (F.col("__o") > F.col("__c")) & (F.col("__r") > F.col("__c"))
    return counted.withColumn(out, inside.cast("int")).drop("__o", "__c", "__r")


def label_until(df: DataFrame, axis: Axis, start: str, end: str, event: str = "event",
                end_col: str | None = None, out: str = "active") -> DataFrame:
    """From each start mark up to (not including) the trial's first end mark; no end, no label."""
    end_col = end_col or event
    counted = running(df, axis, {
        "__s": ("sum", _hits(event, start)), "__e": ("sum", _hits(end_col, end)),
        "__n": ("total", _hits(end_col, end))})
    inside = (F.col("__s") > 0) & (F.col("__e") == 0) & (F.col("__n") > 0)
    return counted.withColumn(out, inside.cast("int")).drop("__s", "__e", "__n")


def slot_in(main: DataFrame, side: DataFrame, axis: Axis, side_axis: Axis, marker: str, cols: Sequence[str],
            event: str = "event") -> DataFrame:
    """The i-th side row of a trial overwrites the i-th main row at or after the trial's marker.

    Side rows beyond the trial are ignored; NULLs of the side overwrite too.
    """
    key = list(axis.keys)
    placed = positions(main, axis, "__pos")
    start = placed.where(F.col(event) == marker).groupBy(*key).agg(F.min("__pos").alias("__m"))
    placed = attach(placed, start, key).withColumn("__i", F.col("__pos") - F.col("__m"))
    new = positions(side, side_axis, "__i").select(
        *key, "__i", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in cols])
    out = placed.join(new, [*key, "__i"], "left")
    over = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in cols}
    return out.withColumns(over).select(*main.columns)


def shift_label(df: DataFrame, axis: Axis, n: int, label: str = "label") -> DataFrame:
    """Labels move ``n`` samples earlier inside the trial; the tail is 0. ``n <= 0`` changes nothing.

    Only the (sparse) non-zero labels travel, by an equi-join on the row position.
    """
    if n <= 0:
        return df
    placed = positions(df, axis, "__pos")
    hits = (placed.where(F.col(label) != 0)
            .select(*axis.keys, (F.col("__pos") - n).alias("__pos"), F.col(label).alias("__y")))
    return (placed.join(hits, [*axis.keys, "__pos"], "left")
            .withColumn(label, F.coalesce(F.col("__y"), F.lit(0))).select(*df.columns))


def prelabel(df: DataFrame, axis: Axis, n: int, label: str = "label") -> DataFrame:
    """Also mark the ``n`` rows before the first positive of a trial."""
    key = list(axis.keys)
    placed = positions(df, axis, "__pos")
    first = placed.where(F.col(label) == 1).groupBy(*key).agg(F.min("__pos").alias("__f"))
    lead = F.col("__f").isNotNull() & (F.col("__pos") >= F.col("__f") - n) & (F.col("__pos") < F.col("__f"))
    return (attach(placed, first, key)
            .withColumn(label, F.when(lead, 1).otherwise(F.col(label))).select(*df.columns))


def peak_row(placed: DataFrame, key: Sequence[str], col: str, limit: int, pos: str = "pos") -> DataFrame:
    """Per trial: position and value of the maximum over the first ``limit`` rows (first row on ties)."""
    best = (placed.where((F.col(pos) < limit) & F.col(col).isNotNull()).groupBy(*key)
            .agg(F.max(F.struct(F.col(col).alias("v"), (-F.col(pos)).alias("p"))).alias("b")))
    return best.select(*key, (-F.col("b.p")).alias("peak_pos"), F.col("b.v").alias("peak_value"))


def nearest_row(placed: DataFrame, key: Sequence[str], col: str, targets: DataFrame, pos: str = "pos") -> DataFrame:
    """Per trial: the row before ``peak_pos`` whose value is nearest ``target`` (first on ties).

    ``targets`` holds the key, ``peak_pos`` and ``target``.
    """
    near = attach(placed, targets, list(key), "inner").where(
        (F.col(pos) < F.col("peak_pos")) & F.col(col).isNotNull())
    return (near.groupBy(*key)
            .agg(F.min(F.struct(F.abs(F.col(col) - F.col("target")).alias("d"), F.col(pos).alias("p"))).alias("b"))
            .select(*key, F.col("b.p").alias("near_pos"), F.col("b.d").alias("distance")))


def first_equal_after(placed: DataFrame, key: Sequence[str], col: str, peaks: DataFrame, value: float,
                      pos: str = "pos") -> DataFrame:
    """Per trial: the first row at or after the peak, the trial's last row excepted, equal to ``value``."""
    last = placed.groupBy(*key).agg(F.max(pos).alias("__last"))
    after = attach(placed, attach(peaks, last, list(key)), list(key), "inner").where(
        (F.col(pos) >= F.col("peak_pos")) & (F.col(pos) < F.col("__last")) & (F.col(col) == F.lit(value)))
    return after.groupBy(*key).agg(F.min(pos).alias("equal_pos"))


def apply_event_rules(df: DataFrame, axis: Axis, rules: DataFrame, level: str, start_event: str, end_event: str,
                      base: float, limit: int, event: str = "event", end_col: str = "event") -> DataFrame:
    """Insert missing marks from a rules table.

    ``rules``: key, ``g`` (NULL = end mark only), ``add_end``, ``clear_existing``. The start mark
    goes to the row before the peak nearest ``g``; the end mark to the first row from the peak on
    that is back at ``base``.
    """
    key = list(axis.keys)
    placed = positions(df, axis, "__pos")
    scoped = attach(placed, rules, key, "inner")
    peaks = peak_row(scoped, key, level, limit, "__pos")
    targets = attach(peaks, rules, key, "inner").withColumnRenamed("g", "target")
    starts = nearest_row(scoped, key, level, targets.where("target is not null").select(*key, "peak_pos", "target"),
                         "__pos")
    ends = first_equal_after(scoped, key, level, targets.where("add_end").select(*key, "peak_pos"), base, "__pos")
    marks = (rules.select(*key, F.col("clear_existing").alias("__clear"))
             .join(starts.select(*key, F.col("near_pos").alias("__start")), key, "left")
             .join(ends.select(*key, F.col("equal_pos").alias("__end")), key, "left"))
    out = attach(placed, marks, key)
    kept = F.when(F.coalesce(F.col("__clear"), F.lit(False)) & (F.col(event) == start_event), None).otherwise(
        F.col(event))
    started = F.when(F.col("__pos") == F.col("__start"), F.lit(start_event)).otherwise(kept)
    if end_col == event:
        ended = F.when(F.col("__pos") == F.col("__end"), F.lit(end_event)).otherwise(started)
        return out.withColumn(event, ended).select(*df.columns)
    return (out.withColumn(event, started)
            .withColumn(end_col, F.when(F.col("__pos") == F.col("__end"), F.lit(end_event)).otherwise(F.col(end_col)))
            .select(*df.columns))
