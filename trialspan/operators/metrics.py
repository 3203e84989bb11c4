"""Classification metrics, fold summaries and result tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.sizing import attach_one
from ..functions.timeline import running, sorted_axis

METRICS = ["accuracy", "precision", "recall", "f1", "specificity", "g_mean"]


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Truth by prediction counts, one row per truth class."""
    return (df.groupBy(F.col(y).alias("truth"))
            .agg(F.count_if(F.col(p) == 0).alias("pred_0"), F.count_if(F.col(p) == 1).alias("pred_1")))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    zero = lambda a, b: ratio(a, b, 0.0)
    recall, spec = zero(tp, tp + fn), zero(tn, tn + fp)
    return {"accuracy": zero(tp + tn, tp + fp + fn + tn), "precision": zero(tp, tp + fp), "recall": recall,
            "f1": zero(2 * tp, 2 * tp + fp + fn), "specificity": spec, "g_mean": F.sqrt(recall * spec)}


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and g-mean; a zero denominator gives 0."""
    hit, pos = F.col(p) == 1, F.col(y) == 1
    aggs = [F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
            F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")]
    counts = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    made = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*keys, "tp", "fp", "fn", "tn", *[e.alias(n) for n, e in made.items()])


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """ROC points, one per distinct score: cumulative true and false positives from the top.

    Scores are counted first; the cumulative sums run over sort ranges of the distinct scores.
    """
    by_score = df.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("__o")).agg(
        F.count_if(F.col(y) == 1).alias("__p"), F.count_if(F.col(y) != 1).alias("__q"))
    ranged, axis = sorted_axis(by_score, ["__o"])
    out = running(ranged, axis, {"tp": ("sum", F.col("__p")), "fp": ("sum", F.col("__q")),
                                 "__tp": ("total", F.col("__p")), "__tq": ("total", F.col("__q"))})
    return out.select((-F.col("__o")).alias("score"), "tp", "fp", ratio(F.col("tp"), F.col("__tp")).alias("tpr"),
                      ratio(F.col("fp"), F.col("__tq")).alias("fpr"), F.col("__p").alias("d_tp"),
                      F.col("__q").alias("d_fp"), F.col("__tp").alias("n_pos"), F.col("__tq").alias("n_neg"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve (ties count one half)."""
    pts = roc_curve(df, y, score)
    area = F.col("d_fp").cast("double") * (F.col("tp") - F.col("d_tp") / 2.0)
    return pts.agg(F.try_divide(F.sum(area), F.max("n_pos").cast("double") * F.max("n_neg")).alias("auc"))


def summarize_folds(folds: DataFrame, metrics: Sequence[str] = tuple(METRICS), keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per metric over the folds, long form."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"))
                      for m in metrics])
    aggs = [F.count(F.lit(1)).alias("n_folds"), parts.alias("__s")]
    out = folds.groupBy(*keys).agg(*aggs) if keys else folds.agg(*aggs)
    return out.select(*keys, "n_folds", F.inline("__s"))


def median_fold(folds: DataFrame, carry: Sequence[str] = (), keys: Sequence[str] = (), f1: str = "f1",
                fold: str = "fold") -> DataFrame:
    """Upper-median F1 (sorted position n // 2) and the first fold that holds it, with its columns.

    A group is the folds of one model, so the sorted list is as short as the number of folds.
    """
    row = F.struct(F.col(f1).alias("v"), F.col(fold).alias("f"))
    ranked = folds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(f1))).alias("__v"),
                                      F.array_sort(F.collect_list(row)).alias("__r")) if keys else folds.agg(
        F.array_sort(F.collect_list(F.col(f1))).alias("__v"), F.array_sort(F.collect_list(row)).alias("__r"))
    med = ranked.withColumn("__m", F.get("__v", F.floor(F.size("__v") / 2).cast("int")))
    at = med.select(*keys, F.col("__m").alias("f1_median"),
                    F.array_min(F.transform(F.filter("__r", lambda r: r["v"] == F.col("__m")),
                                            lambda r: r["f"])).alias(fold))
    return at.join(folds.select(*keys, fold, *carry), [*keys, fold]) if carry else at


def f1_ci(folds: DataFrame, model: str = "model", f1: str = "f1") -> DataFrame:
    """Median F1, count, sample deviation and 95 % half width per model, and the best model."""
    n, s = F.count(f1), F.stddev_samp(f1)
    out = folds.groupBy(model).agg(F.median(f1).alias("median"), n.alias("n"), s.alias("std"),
                                   (1.96 * s / F.sqrt(n)).alias("ci95"))
    best = out.agg(F.max(F.struct("median", F.col(model).alias("m")))["m"].alias("best_model"))
    return attach_one(out, best).withColumn("is_best", F.col(model) == F.col("best_model"))


def balanced_summary(folds: DataFrame, model: str = "model") -> DataFrame:
    """F1, recall and specificity with deviation and CI; balanced accuracy adds means and CIs."""
    aggs = []
    for m in ("f1", "recall", "specificity"):
        s = F.stddev_samp(m)
        aggs += [F.avg(m).alias(f"{m}_mean"), s.alias(f"{m}_std"), (1.96 * s / F.sqrt(F.count(m))).alias(f"{m}_ci")]
    out = folds.groupBy(model).agg(*aggs)
    return out.withColumns({
        "balanced_accuracy": (F.col("recall_mean") + F.col("specificity_mean")) / 2,
        "balanced_ci": F.col("recall_ci") + F.col("specificity_ci")})


def metric_curve(results: DataFrame, x: str, metric: str = "f1", band: str = "std", rate: float = 1.0) -> DataFrame:
    """Metric over horizon or offset: mean with a ``std``, ``sem`` or ``minmax`` band; x / rate is time."""
    mean, s = F.avg(metric), F.stddev_samp(metric)
    if band == "std":
        lo, hi = mean - s, mean + s
    elif band == "sem":
        sem = s / F.sqrt(F.count(metric))
        lo, hi = mean - sem, mean + sem
    elif band == "minmax":
        lo, hi = F.min(metric), F.max(metric)
    else:
        raise ValueError(f"unknown band: {band}")
    return results.groupBy(x).agg((F.col(x) / F.lit(float(rate))).alias("seconds"), mean.alias("mean"),
                                  lo.alias("low"), hi.alias("high"))


def metrics_table(results: DataFrame, model: str = "model", metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """One row per metric, one column per classifier (mean over rows)."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return results.select(model, F.inline(parts)).groupBy("metric").pivot(model).agg(F.avg("value"))


def union_runs(runs: dict[str, DataFrame], label: str = "run") -> DataFrame:
    """Stack runs under a label; all runs must have the same columns."""
    names = {k: set(df.columns) for k, df in runs.items()}
    first = next(iter(names.values()))
    odd = [k for k, cols in names.items() if cols != first]
    if odd:
        raise ValueError(f"runs with other columns: {odd}")
    out = None
    for k, df in runs.items():
        tagged = df.withColumn(label, F.lit(k))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def histogram(df: DataFrame, col: str, bins: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the whole range; the last bin is closed."""
    span = df.agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"))
    pos = F.floor(ratio((F.col(col) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"), 0.0))
    return (attach_one(df.where(F.col(col).isNotNull()), span)
            .groupBy(*by, F.least(pos, F.lit(bins - 1)).alias("bin"), "__lo", "__hi")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*by, "bin", (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("edge"),
                    "n"))


def threshold_curve(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", y: str = "label", bins: int = 1000,
                    least: float = 0.1, most: float = 0.9) -> DataFrame:
    """(keys, threshold, tp, fp, fn, f1) for every threshold k / bins in a range, where scores of at least it are positive.

    Scores are counted by bin first; cumulated counts give the whole curve, so its cost does not follow the rows.
    """
    lo, hi = math.ceil(least * bins - 1e-9), math.floor(most * bins + 1e-9)
    at = F.greatest(F.least(F.floor(F.col(score) * bins), F.lit(hi)), F.lit(lo - 1)).cast("int")
    counts = scored.select(*keys, at.alias("__b"), (F.col(y) == 1).alias("__pos")).groupBy(*keys, "__b").agg(
        F.count_if("__pos").alias("__p"), F.count_if(~F.col("__pos")).alias("__q"))
    # every key has all bins; few rows a key
    each = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__b", F.struct("__p", "__q").alias("c")))).alias("__m"), F.sum("__p").alias("__all"))
    grid = each.select(*keys, "__all", "__m", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("__b"))
    grid = grid.select(*keys, "__all", "__b", F.coalesce(F.col("__m")[F.col("__b")]["__p"], F.lit(0)).alias("__p"), F.coalesce(F.col("__m")[F.col("__b")]["__q"], F.lit(0)).alias("__q"))
    above = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = grid.select(*keys, (F.col("__b") / F.lit(float(bins))).alias("threshold"), F.sum("__p").over(above).alias("tp"), F.sum("__q").over(above).alias("fp"), "__all")
    return out.select(*keys, "threshold", "tp", "fp", (F.col("__all") - F.col("tp")).alias("fn"), ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("__all"), 0.0).alias("f1"))


def best_threshold(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The smallest threshold with the largest F1, a row a key."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t")))
    out = curve.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, (-F.col("b.t")).alias("threshold"), "b.f1")


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return attach_one(counts, total).select(y, "n", (F.col("__t") / (F.col("__k") * F.col("n"))).alias("weight"))


def metrics_by_subject(df: DataFrame, subject: str, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    return binary_metrics(df, y, p, [subject, model])


def running_best(trials: DataFrame, by: Sequence[str], step: str = "step", value: str = "f1") -> DataFrame:
    """Best value so far over tuning steps (a search has few steps per key)."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return trials.withColumn("best", F.max(value).over(w))


def top_features(effects: DataFrame, n: int, feature: str = "feature", value: str = "shap") -> DataFrame:
    """The n features with the largest summed absolute effect."""
    return (effects.groupBy(feature).agg(F.sum(F.abs(F.col(value))).alias("total"))
            .orderBy(F.col("total").desc(), feature).limit(n))


def results_long(nested: DataFrame, keys: Sequence[str], metric: str = "f1") -> DataFrame:
    """Arrays of fold metrics to one row per fold."""
    return nested.select(*keys, F.posexplode(metric).alias("fold", metric))


def ablation_review(results: DataFrame, group: str = "grp", f1: str = "f1", sort: bool = True) -> DataFrame:
    """Median, mean and count of F1 per stream group, best first if asked."""
    out = results.groupBy(group).agg(F.median(f1).alias("median"), F.avg(f1).alias("mean"), F.count(f1).alias("n"))
    return out.orderBy(F.col("median").desc(), group) if sort else out
