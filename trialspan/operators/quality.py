"""Missing-data profiles and per-trial data quality."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import any_null, ratio
from ..functions.sizing import attach, attach_one
from ..functions.timeline import Axis, running, sorted_axis


def null_profile(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long form per key and feature: rows, NULL count and NULL proportion."""
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"__c_{c}") for c in cols])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col("n") - F.col(f"__c_{c}")).alias("n_null"))
                      for c in cols])
    return (wide.select(*keys, "n", F.inline(parts))
            .withColumn("null_share", ratio(F.col("n_null"), F.col("n"))))


def null_during_event(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str) -> DataFrame:
    """Per key: share of event rows with any NULL (NULL when the key has no event row), whether
    any feature is entirely NULL, and whether it is so during the event."""
    hit, hole = F.col(label) == 1, any_null(list(cols))
    full = [(F.count(c) == 0).cast("int") for c in cols]
    full_event = [(F.count(F.when(hit, F.col(c))) == 0).cast("int") for c in cols]
    out = df.groupBy(*keys).agg(
        F.count_if(hit).alias("n_event"),
        F.count_if(hit & hole).alias("n_event_null"),
        F.greatest(*full, F.lit(0)).alias("any_all_null"),
        F.greatest(*full_event, F.lit(0)).alias("__fe"),
    )
    return out.select(*keys, "n_event", "n_event_null",
                      ratio(F.col("n_event_null"), F.col("n_event")).alias("event_null_share"), "any_all_null",
                      F.when(F.col("n_event") > 0, F.col("__fe")).alias("event_all_null"))


def incomplete_summary(profile: DataFrame) -> DataFrame:
    """Counts over :func:`null_during_event`."""
    return profile.agg(F.count(F.lit(1)).alias("n_trials"), F.sum("any_all_null").alias("n_all_null"),
                       F.count("event_all_null").alias("n_with_event"),
                       F.coalesce(F.sum("event_all_null"), F.lit(0)).alias("n_event_all_null"))


def drop_incomplete_groups(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Remove groups in which at least one feature is entirely NULL."""
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"__c_{c}") for c in cols])
    bad = counts.where(F.least(*[F.col(f"__c_{c}") for c in cols], F.lit(1)) == 0).select(*keys)
    return attach(df, bad, list(keys), "left_anti")


def fill_from_condition(df: DataFrame, flag: str, owned: dict[int, Sequence[str]]) -> DataFrame:
    """Columns owned by one condition: rows of the other one get the owner's mean where NULL."""
    cols = [(cond, c) for cond, cs in owned.items() for c in cs]
    means = df.agg(*[F.avg(F.when(F.col(flag) == cond, F.col(c))).alias(f"__m_{c}") for cond, c in cols])
    repl = {c: F.when((F.col(flag) == 1 - cond) & F.col(c).isNull(), F.col(f"__m_{c}")).otherwise(F.col(c))
            for cond, c in cols}
    return attach_one(df, means).withColumns(repl).drop(*[f"__m_{c}" for _, c in cols])


def onset_latency(df: DataFrame, key: str, ts: str, event: str, onset: str, level: str, level_min: float,
                  start: float, starts: DataFrame | None = None) -> DataFrame:
    """Per trial: first onset time minus first time the level is reached, both after ``start``.

    ``starts`` (key, ``start``) overrides the start of single trials.
    """
    if starts is not None:
        df = attach(df, starts.select(key, F.col("start").alias("__s")), [key])
        begin = F.coalesce(F.col("__s"), F.lit(float(start)))
    else:
        begin = F.lit(float(start))
    late = F.col(ts) >= begin
    out = df.groupBy(key).agg(
        F.min(F.when(late & (F.col(event) == onset), F.col(ts))).alias("t_onset"),
        F.min(F.when(late & (F.col(level) >= level_min), F.col(ts))).alias("t_level"))
    return out.where("t_onset is not null and t_level is not null").withColumn(
        "latency", F.col("t_onset") - F.col("t_level"))


def quantiles(long: DataFrame, qs: Sequence[float], feature: str = "feature", x: str = "x") -> DataFrame:
    """Exact quantiles with linear interpolation per feature of a long table, columns ``q0``, ``q1``...

    Values are counted, then ranked over sort ranges of (feature, value), so neither a feature nor
    its distinct values have to fit one task.
    """
    counts = long.where(F.col(x).isNotNull()).groupBy(feature, x).agg(F.count(F.lit(1)).alias("__c"))
    ranged, axis = sorted_axis(counts, [feature, x])
    run = running(ranged, Axis((feature,), (x,), axis.block),
                  {"__hi": ("sum", F.col("__c")), "__n": ("total", F.col("__c"))})
    aggs = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("__n") - 1)
        for side, pos in (("a", F.floor(at)), ("b", F.ceil(at))):
            here = (pos < F.col("__hi")) & (pos >= F.col("__hi") - F.col("__c"))
            aggs.append(F.max(F.when(here, F.col(x))).alias(f"__{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"__f{i}"))
    picked = run.groupBy(feature).agg(*aggs)
    return picked.select(feature, *[(F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}"))
                                    .alias(f"q{i}") for i in range(len(qs))])


WINDOW_ROWS = 1_000_000  # values of one bracket that a task may rank


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """Exact quantiles with linear interpolation of many columns, columns ``feature``, ``q0``, ``q1``...

    Approximate quantiles bracket each one; then only the values inside the brackets, about 4 / ``accuracy`` of the rows,
    are counted and ranked. A bracket that turns out not to hold its quantile is widened to all values and counted again.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    margin = 2.0 / accuracy
    ends = sorted({min(1.0, max(0.0, q + s)) for q in qs for s in (-margin, margin)})
    told = df.agg(F.array(*[F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                                     F.percentile_approx(v, ends, accuracy).alias("at")) for v in x.values()]).alias("t")).first()["t"]
    wanted, done = {}, None  # (column, quantile) -> rows, bracket
    for i, t in enumerate(told):
        for j, q in enumerate(qs):
            if t["n"]:
                lo, hi = q - margin, q + margin
                wanted[i, j] = (t["n"], t["at"][ends.index(lo)] if lo > 0 else t["lo"], t["at"][ends.index(hi)] if hi < 1 else t["hi"])
    while wanted:
        keys = list(wanted)
        inside = F.array(*[F.struct(F.lit(k).alias("k"), x[cols[i]].alias("x"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                           for k, (i, j) in enumerate(keys) for _, lo, hi in [wanted[i, j]]])
        near = df.select(F.inline(F.filter(inside, lambda r: (r["x"] >= r["lo"]) & (r["x"] <= r["hi"]))))
        counts = near.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
        below = df.agg(F.array(*[F.count_if(x[cols[i]] < lo) for i, j in keys for _, lo, _ in [wanted[i, j]]]).alias("b")).first()["b"]
        if done is None and max(n for n, _, _ in wanted.values()) * 3 * margin <= WINDOW_ROWS:
            run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("x")))
        else:  # too many values for one task
            ranged, axis = sorted_axis(counts, ["k", "x"])
            run = running(ranged, Axis(("k",), ("x",), axis.block), {"upto": ("sum", F.col("c"))})
        at = [q * (n - 1) - below[k] for k, (i, j) in enumerate(keys) for q, n in [(qs[j], wanted[i, j][0])]]
        place = F.array(*[F.lit(float(a)) for a in at])[F.col("k")]
        pick = lambda pos: F.max(F.when((pos < F.col("upto")) & (pos >= F.col("upto") - F.col("c")), F.col("x")))
        got = {r["k"]: (r["a"], r["b"]) for r in run.withColumn("at", place).groupBy("k").agg(
            pick(F.floor("at")).alias("a"), pick(F.ceil("at")).alias("b")).collect()}
        found = []
        for k, (i, j) in enumerate(keys):
            a, b = got.get(k, (None, None))
            if a is not None and b is not None:
                found.append((cols[i], j, a + (b - a) * (at[k] - math.floor(at[k]))))
                del wanted[i, j]
            else:
                wanted[i, j] = (wanted[i, j][0], told[i]["lo"], told[i]["hi"])
        done = found if done is None else done + found
    values = {(c, j): v for c, j, v in done or []}
    rows = [(c, *[values.get((c, j)) for j in range(len(qs))]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"q{j} double" for j in range(len(qs))))


def latency_summary(lat: DataFrame) -> DataFrame:
    """Mean, median, max, min, range and population deviation over the trials."""
    v = F.col("latency").cast("double")
    half = quantiles(lat.select(F.lit("latency").alias("feature"), v.alias("x")), [0.5])
    base = lat.agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"),
                   (F.max(v) - F.min(v)).alias("range"), F.stddev_pop(v).alias("std"))
    return attach_one(base, half.agg(F.max("q0").alias("median")))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, NULLs, mean, sample deviation and exact linear quartiles, one row per column."""
    n = F.count(F.lit(1))
    parts = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.count(c).alias("n"), (n - F.count(c)).alias("n_null"),
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
        F.max(c).cast("double").alias("max")) for c in cols])
    quarts = column_quantiles(df, list(cols), [0.25, 0.5, 0.75])
    return df.agg(parts.alias("p")).select(F.inline("p")).join(quarts, "feature", "left").withColumnsRenamed(
        {"q0": "q25", "q1": "q50", "q2": "q75"})


def label_distribution(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Class counts, percentage (2 places) and event rate."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__t"),
                                      F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("__p"))
    joined = attach(counts, total, list(keys)) if keys else attach_one(counts, total)
    return joined.select(*keys, label, "n", F.round(100.0 * F.col("n") / F.col("__t"), 2).alias("percent"),
                         (F.col("__p") / F.col("__t")).alias("event_rate"))


def compare_shapes(raw: DataFrame, engineered: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row and column counts of the raw and the engineered table (``keys`` are not features)."""
    def shape(df: DataFrame, name: str) -> DataFrame:
        width = len([c for c in df.columns if c not in keys])
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("dataset"), "n_rows", F.lit(width).cast("bigint").alias("n_features"))
    return shape(raw, "raw").unionByName(shape(engineered, "engineered"))
