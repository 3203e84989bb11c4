"""Projection, recoding, filtering and row/column deletion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import nan_to_null, ratio
from ..functions.sizing import attach
from ..functions.timeline import global_positions

# Recodings of the recording format and the resting centrifuge level.
CONDITION_CODES = {"N": 0, "AFE": 1}
RESPONSE_CODES = {"correct": 1, "no response": 0, "incorrect": -1, "NO VALUE": None}
BASELINE_G = 1.2


def split_trial_id(df: DataFrame, col: str = "trial_id") -> DataFrame:
    """Split ``SS-TT`` into ``subject`` and ``trial``."""
    parts = F.split(F.col(col), "-")
    return df.withColumns({"subject": F.get(parts, 0), "trial": F.get(parts, 1)})


def recode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None, keep_other: bool = False) -> DataFrame:
    """Replace values by a mapping; values outside it become NULL or are kept."""
    c = F.col(col)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    if keep_other:
        expr = expr.otherwise(c.try_cast("double"))
    return df.withColumn(out or col, expr)


def diff_cols(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(left) - F.col(right))


def ratio_cols(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    return df.withColumn(out, ratio(F.col(num), F.col(den)))


def fill_const(df: DataFrame, cols: Sequence[str], value: float = BASELINE_G) -> DataFrame:
    return df.na.fill(value, list(cols))


def filter_scope(df: DataFrame, kind: int, subject=None, trial=None, subject_col: str = "subject",
                 trial_col: str = "trial") -> DataFrame:
    """0 = one trial of one subject, 1 = one subject, 2 = everything."""
    if kind == 0:
        return df.where((F.col(subject_col) == F.lit(subject)) & (F.col(trial_col) == F.lit(trial)))
    if kind == 1:
        return df.where(F.col(subject_col) == F.lit(subject))
    if kind == 2:
        return df
    raise ValueError(f"unknown scope kind: {kind}")


def keep_groups(df: DataFrame, keys: Sequence[str], flag: str, want: int = 0) -> DataFrame:
    """Keep whole groups: ``want=0`` drops groups with any flag 1, ``want=1`` keeps only those."""
    flagged = df.where(F.col(flag) == 1).select(*keys).distinct()
    return attach(df, flagged, list(keys), "left_anti" if want == 0 else "left_semi")


def non_null_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """One aggregate row, read by the driver: a count per column."""
    return df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first().asDict()


def drop_all_null_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = non_null_counts(df, cols)
    return df.drop(*[c for c in cols if counts[c] == 0])


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def column_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: min, max, non-null count and row count (long form, one pass)."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(c).alias("col"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                 F.count(c).alias("n_present")) for c in cols]).alias("s"))
    return stats.select("n", F.inline("s"))


def constant_cols(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with one value and no NULL (a column holding a NULL never counts)."""
    rows = column_ranges(df, cols).where("lo = hi and n_present = n").select("col").collect()
    return [r[0] for r in rows]


def drop_constant_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*constant_cols(df, cols))


def ordinal_codes(df: DataFrame, key: str, order: Sequence[str], out: str = "code") -> DataFrame:
    """1-based code of each key by first appearance in ``order``."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    ordered = first.select(key, *[F.col("__first")[o].alias(f"__o{i}") for i, o in enumerate(order)])
    codes = global_positions(ordered, [f"__o{i}" for i in range(len(order))] + [key], out)
    return attach(df, codes.select(key, (F.col(out) + 1).alias(out)), [key])


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and infinities become 0 (before a distance search)."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def decide(df: DataFrame, score: str, threshold: float, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= F.lit(float(threshold))).cast("int"))


def floats_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    return df.select(*[nan_to_null(F.col(f"`{c}`")).alias(c) if t in ("float", "double") else F.col(f"`{c}`")
                       for c, t in df.dtypes])
