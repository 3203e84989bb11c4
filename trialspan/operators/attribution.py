"""Shapley values and grouped attribution in long form (row, feature, class, value, data)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_key
from ..functions.sizing import attach, attach_one
from .catalog import EEG_BANDS

# Keyword groupings of feature names.
ELECTRODES = ["F1", "Fz", "F3", "FC3", "FT9", "FC5", "FC1", "C3", "C5", "TP9", "CP5", "CP1", "Pz", "P3", "P7", "P5",
              "P1", "P6", "P4", "P8", "TP10", "CP6", "CP2", "Cz", "C4", "T8", "FT10", "FC6", "FC2", "AF4", "FC4", "AFz",
              "O2", "F4", "O1", "T7"]
MODALITIES = {"ECG": "Equivital", "HR": "Equivital", "BR": "Equivital", "Temperature": "Equivital",
              "HRV": "Equivital", "Equivital": "Equivital", "EEG": "EEG", "Centrifuge": "G-Force",
              "Pupil": "Eye Tracking", "Participant": "Demographics"}
PREFIX_GROUPINGS = {"channels", "channels_bands", "raw_processed", "raw_vs_psd"}


def keyword_map(grouping: str) -> dict[str, str]:
    """Keyword to display name of one of the seven groupings."""
    if grouping == "modalities":
        return dict(MODALITIES)
    if grouping == "baseline":
        return {f"v{i}": f"v{i}" for i in range(9)}
    if grouping == "channels":
        return {e: e for e in ELECTRODES}
    if grouping == "bands":
        return {b: b for b in EEG_BANDS}
    banded = {f"{e}_{b}": f"{e}_{b}" for e in ELECTRODES for b in EEG_BANDS}
    if grouping == "channels_bands":
        return banded
    if grouping == "raw_processed":
        return {**banded, **{e: e for e in ELECTRODES}}
    if grouping == "raw_vs_psd":
        raw = {f"{e} ": f"{e}_Raw" for e in ELECTRODES}
        return {**raw, **{f"{e}_{b} ": f"{e}_PSD" for e in ELECTRODES for b in EEG_BANDS}}
    raise ValueError(f"unknown grouping: {grouping}")


def matching_groups(features: DataFrame, keywords: Mapping[str, str], prefix: bool, feature: str = "feature") -> DataFrame:
    """(feature, grp) for every group a feature name matches, each group once."""
    name = F.lower(F.col(feature))
    marks = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(v).alias("g")) for k, v in keywords.items()])
    test = (lambda m: F.startswith(name, m["k"])) if prefix else (lambda m: F.contains(name, m["k"]))
    hits = F.array_distinct(F.transform(F.filter(marks, test), lambda m: m["g"]))
    return features.select(feature).distinct().select(feature, F.explode(hits).alias("grp"))


def group_attribution(long: DataFrame, keywords: Mapping[str, str], prefix: bool = False, mode: str = "sum_abs",
                      row: str = "row_id", feature: str = "feature", value: str = "shap",
                      data: str = "data") -> DataFrame:
    """Per row and group: sum or mean of absolute effects, and the mean of the data.

    Names are matched once per feature; the value table only joins the small result.
    """
    if mode not in ("sum_abs", "mean_abs"):
        raise ValueError(f"unknown mode: {mode}")
    groups = matching_groups(long, keywords, prefix, feature)
    size = F.abs(F.col(value))
    agg = F.sum(size) if mode == "sum_abs" else F.avg(size)
    return (attach(long, groups, [feature], "inner").groupBy(row, "grp")
            .agg(agg.alias("value"), F.avg(data).alias("data"), F.count(F.lit(1)).alias("matches")))


def group_stats(long: DataFrame, keywords: Mapping[str, str], prefix: bool = False, row: str = "row_id",
                feature: str = "feature", value: str = "shap") -> DataFrame:
    """Match count and row statistics of every group."""
    groups = matching_groups(long, keywords, prefix, feature)
    size = F.abs(F.col(value))
    rows = (attach(long, groups, [feature], "inner").groupBy(row, "grp")
            .agg(F.sum(size).alias("s"), F.avg(size).alias("m"), F.count(F.lit(1)).alias("k")))
    return rows.groupBy("grp").agg(F.max("k").alias("matches"), F.avg("m").alias("mean_abs_mean"),
                                   F.stddev_pop("m").alias("mean_abs_std"), F.avg("s").alias("sum_abs_mean"),
                                   F.stddev_pop("s").alias("sum_abs_std"), F.sum("s").alias("total_abs"))


def select_class(long: DataFrame, index: int = 1, cls: str = "class") -> DataFrame:
    return long.where(F.col(cls) == index)


def shapley_linear(df: DataFrame, id_col: str, cols: Sequence[str], coefficients: Mapping[str, float],
                   background: DataFrame | None = None) -> DataFrame:
    """coef x (x - mean) per row and feature; means over ``background`` (or the rows)."""
    means = (background if background is not None else df).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (F.lit(float(coefficients[c])) * (F.col(c) - F.col(f"__m_{c}"))).alias("shap"),
                               F.col(c).cast("double").alias("data")) for c in cols])
    return attach_one(df, means).select(F.col(id_col).alias("row_id"), F.inline(parts))


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int | str) -> DataFrame:
    """n rows by md5 order (a sampling operator)."""
    return df.orderBy(hash_key(id_col, seed=seed), id_col).limit(n)


def shapley_permutation(score: Callable[[DataFrame], DataFrame], train: DataFrame, test: DataFrame, id_col: str,
                        cols: Sequence[str], n_background: int = 100, n_test: int | None = 50,
                        seed: int = 42, out: str = "score") -> DataFrame:
    """Permutation Shapley values with 2 d + 1 masked evaluations per row.

    ``score`` adds the model output to a frame with the feature columns. Features switch from the
    background to the row in a per-row md5 order, and back in the reverse order; each feature
    gets half the sum of its two steps. All evaluations of all rows go through one scoring pass.
    """
    d = len(cols)
    pack = lambda df: F.array(*[F.col(c).cast("double") for c in cols])
    back = hash_sample(train, id_col, n_background, f"{seed}:b").select(pack(train).alias("b"))
    backs = back.agg(F.collect_list("b").alias("backs"))  # bounded by n_background rows
    rows = (hash_sample(test, id_col, n_test, f"{seed}:t") if n_test else test).select(
        F.col(id_col).alias("row_id"), pack(test).alias("x"))
    order = F.transform(F.array_sort(F.array(*[
        F.struct(hash_key("row_id", F.lit(i), seed=seed).alias("h"), F.lit(i).alias("i")) for i in range(d)])),
        lambda s: s["i"])
    # place of each feature in the row's order
    place = F.transform(F.array_sort(F.transform("order", lambda i, k: F.struct(i.alias("i"), k.alias("k")))), lambda s: s["k"])
    steps = (attach_one(rows, backs).withColumn("order", order).withColumn("place", place)
             .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2 * d)))))
    # steps 0..d switch on the first `step` features; steps d+1..2d switch the same ones off again
    masked = steps.withColumn("b", F.explode("backs"))
    on = lambda i: F.when(F.col("step") <= d, F.get("place", F.lit(i)) < F.col("step")).otherwise(
        F.get("place", F.lit(i)) >= F.col("step") - d)
    fed = masked.select("row_id", "step", *[F.when(on(i), F.get("x", F.lit(i))).otherwise(F.get("b", F.lit(i))).alias(c)
                                            for i, c in enumerate(cols)])
    means = score(fed).groupBy("row_id", "step").agg(F.avg(out).alias("f"))
    path = means.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("step", "f"))).alias("p"))
    f = lambda i: F.get("p", i)["f"]
    # position k of the order: forward f(k+1) - f(k); on the way back f(d+k) - f(d+k+1)
    gain = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: F.struct(
        F.get("order", k).alias("i"), ((f(k + 1) - f(k) + f(F.lit(d) + k) - f(F.lit(d) + k + 1)) / 2).alias("shap")))
    names = F.array(*[F.lit(c) for c in cols])
    return (rows.withColumn("order", order).join(path, "row_id")
            .select("row_id", "x", f(0).alias("base_value"), F.inline(gain))
            .select("row_id", F.get(names, F.col("i")).alias("feature"), "shap", "base_value",
                    F.get("x", F.col("i")).alias("data")))


def probability_score(model) -> Callable[[DataFrame], DataFrame]:
    """Scoring function of an MLlib classifier: probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    return lambda df: model.transform(df).withColumn("score", F.get(vector_to_array("probability"), 1))
