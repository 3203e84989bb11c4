"""Readers: main signal table, side files per trial, per-subject dimensions, band baselines."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeline import Axis, running
from ..operators.clean import floats_to_null, split_trial_id
from .recording import DEMOGRAPHIC_COPIES, DEMOGRAPHICS

# The parts of a side-file name, and the band in a baseline file name.
SIDE_FILE = r"_(\d{2})_DC(\d+)"
BAND_FILE = r"_baseline_([a-z]+)_"


def read_signals(spark: SparkSession, path: str, schema: T.StructType | str, narrow: bool = True,
                 trial: str | None = None, fmt: str | None = None) -> DataFrame:
    """Stacked signal table from CSV or Parquet: NaN to NULL, doubles narrowed to float.

    ``trial`` names a ``SS-TT`` column to split into subject and trial.
    """
    fmt = fmt or ("csv" if re.search(r"\.csv(\.\w+)?$|/\*\.csv", path) else "parquet")
    reader = spark.read.schema(schema)
    df = reader.option("header", True).option("nanValue", "NaN").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    df = floats_to_null(df)
    if narrow:
        df = df.select(*[F.col(f"`{c}`").cast("float").alias(c) if t == "double" else F.col(f"`{c}`")
                         for c, t in df.dtypes])
    return split_trial_id(df, trial) if trial else df


def safe_name(name: str) -> str:
    """A physical column name without spaces, brackets or dots."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", name)).strip("_").lower()


def with_safe_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns safely; also returns safe to original name."""
    names, used = {}, set()
    for c in df.columns:
        base = s = safe_name(c) or "col"
        i = 2
        while s in used:
            s, i = f"{base}_{i}", i + 1
        used.add(s)
        names[s] = c
    return df.toDF(*names), names


def select_device(df: DataFrame, token: str, keep: Sequence[str] = ()) -> DataFrame:
    """Only the columns whose name holds the token (a pruned scan), plus ``keep``."""
    cols = [c for c in df.columns if token in c or c in keep]
    if not any(token in c for c in cols):
        raise ValueError(f"no column holds {token!r}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def _located(df: DataFrame) -> DataFrame:
    """Where each line was read: path, split offset and order inside the split."""
    return df.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start"),
                           "__o": F.monotonically_increasing_id()})


def _numbered(df: DataFrame, keys: Sequence[str], out: str, extra: Mapping | None = None) -> DataFrame:
    """0-based line number inside ``keys``, files in path order; file splits are the blocks."""
    axis = Axis(tuple(keys), ("__o",), "concat(__file, ':', lpad(cast(__at as string), 20, '0'))")
    return running(df, axis, {out: ("rows", F.lit(1)), **(extra or {})}).withColumn(out, F.col(out) - 1)


def read_side_files(spark: SparkSession, glob: str, schema: T.StructType | str, fmt: str = "csv") -> DataFrame:
    """Per-trial side files; ``trial_id`` = ``SS-0T`` from the file (or folder) name, ``row`` = line order.

    Files whose name has no trial are dropped.
    """
    reader = spark.read.schema(schema)
    df = reader.option("header", True).csv(glob) if fmt == "csv" else reader.format(fmt).load(glob)
    part = lambda i: F.regexp_extract("__file", SIDE_FILE, i)
    named = _located(df).where(part(1) != "").withColumn("trial_id", F.concat(part(1), F.lit("-0"), part(2)))
    return _numbered(named, ["trial_id"], "row").drop("__file", "__at", "__o")


def read_subject_dim(spark: SparkSession, path: str, renames: Mapping[str, str], drop_last: bool = False,
                     subjects: int | None = None) -> DataFrame:
    """Per-subject file in subject order: numbered ``01``.. and renamed; optionally without its last row."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    named = _located(raw).select("__file", "__at", "__o", *[F.col(f"`{a}`").alias(b) for a, b in renames.items()])
    lines = _numbered(named, [], "__i", {"__n": ("total", F.lit(1))})
    if drop_last:
        lines = lines.where("__i < __n - 1")
    if subjects is not None:
        lines = lines.where(F.col("__i") < subjects)
    return lines.select(F.format_string("%02d", F.col("__i") + 1).alias("subject"), *renames.values())


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """Demographic file in subject order with the feature names of :mod:`.recording`."""
    df = read_subject_dim(spark, path, DEMOGRAPHICS)
    return df.withColumns({new: F.col(source) for new, source in DEMOGRAPHIC_COPIES.items()})


def read_band_baseline(spark: SparkSession, glob: str) -> DataFrame:
    """One CSV per band, a line per subject, a column per channel: (subject, band, channel, value)."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(glob)
    lines = _located(raw).withColumn("band", F.regexp_extract("__file", BAND_FILE, 1))
    numbered = _numbered(lines, ["band"], "__i").withColumn("subject", F.format_string("%02d", F.col("__i") + 1))
    return numbered.unpivot(["subject", "band"], raw.columns, "channel", "value")
