"""Cross-validation, ablation, sweeps and studies.

Loops over folds, models and variants only submit Spark work; results stay one DataFrame keyed
by what was varied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import cut
from ..functions.timeline import Axis
from ..operators import sampling, selection
from ..operators.baseline import baseline
from ..operators.catalog import preferred_names
from ..operators.clean import drop_null_rows
from ..operators.metrics import best_threshold, binary_metrics, threshold_curve
from ..operators.neighbours import knn_classify
from ..operators.sequences import sequence_windows
from ..operators.windows import Slide, feature_matrix, sliding_label
from ..sources.store import read_median
from .models import WEIGHTED, WINDOWING, candidates, fit, fit_window_logistic, predict, tune, window_scores


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def scored(name: str, train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], y: str,
           params: Mapping | None = None, balanced: bool = False) -> DataFrame:
    """Test rows with their truth and predicted class ``p``."""
    if name == "KNN":
        p = dict(params or {})
        votes = knn_classify(train, test, id_col, cols, y, p.get("k", 5), p.get("weights", "uniform"), p.get("p", 2))
        return test.select(id_col, y).join(votes.select(id_col, F.col("prediction").alias("p")), id_col)
    return predict(fit(name, train, cols, y, params, balanced), test.select(id_col, y, *cols)).select(id_col, y, "p")


def fold_result(pred: DataFrame, y: str, keys: Mapping[str, object], n_train: int, n_val: int,
                params: Mapping | None, features: Sequence[str]) -> DataFrame:
    """One result row: metrics, sizes, parameters and selected features."""
    lits = {k: F.lit(v) for k, v in keys.items()}
    texts = [F.lit(str(x)) for k, v in (params or {}).items() for x in (k, v)]
    return binary_metrics(pred, y, "p").withColumns({
        **lits, "n_train": F.lit(n_train), "n_val": F.lit(n_val),
        "best_params": F.create_map(*texts) if texts else F.create_map().cast("map<string,string>"),
        "selected_features": F.array(*[F.lit(f) for f in features])})


def cross_validate(df: DataFrame, id_col: str, cols: Sequence[str], y: str, models: Sequence[str], k: int = 10,
                   seed: int = 42, group: str | None = None, alphas: Sequence[float] = selection.ALPHAS,
                   resample: bool = True, trials: int = 0, params: Mapping[str, Mapping] | None = None,
                   balanced: bool = False) -> DataFrame:
    """Per fold: lasso on the training rows, SMOTE on the training rows, fit or tune, metrics.

    Folds split rows by class, or whole groups where ``group`` is given. Where the lasso keeps no column, the fold takes all
    of them; ``selected_features`` tells. ``balanced`` weights the classes in search and fit, for the classifiers that take weights.
    """
    keep = [id_col, y, *([group] if group else []), *cols]
    folded = (sampling.group_folds(df.select(*keep), group, y, k, seed) if group
              else sampling.stratified_folds(df.select(*keep), id_col, y, k, seed))
    folded, out = cut(folded), []
    picks = selection.lasso_by_fold(folded, id_col, cols, y, alphas, seed)
    for fold in range(k):
        train, test = sampling.take_fold(folded, fold, k)
        names = picks[fold] or list(cols)
        n_train, n_val = train.count(), test.count()
        used = train.select(id_col, y, *names)
        if resample:
            made = sampling.smote(used, id_col, y, names, seed=seed)
            # synthetic rows get ids of their own
            used = cut(made.withColumn(id_col, F.when(F.col("copy") < 0, F.col(id_col)).otherwise(
                F.xxhash64(F.col(id_col), F.col("copy")))).drop("copy"))
        for name in models:
            chosen = dict((params or {}).get(name, {}))
            if trials:
                inner = sampling.stratified_folds(used, id_col, y, 3, seed)
                model, chosen, _ = tune(name, inner, names, y, trials, 3, seed, "fold", balanced=balanced, id_col=id_col)
                pred = predict(model, test.select(id_col, y, *names))
            else:
                pred = scored(name, used, test, id_col, names, y, chosen, balanced and name in WEIGHTED)
            out.append(fold_result(pred, y, {"model": name, "fold": fold}, n_train, n_val, chosen, names))
    return stack(out)


def cross_validate_seq(df: DataFrame, axis: Axis, cols: Sequence[str], y: str, k: int = 5, length: int = 25,
                       step: int = 10, threshold: float = 0.5, horizon: int = 0, seed: int = 42) -> DataFrame:
    """Window logistic regression over whole-trial folds; windows never cross trials, so they are
    cut once and carry the fold of their trial."""
    trial = axis.keys[0]
    folds = sampling.group_folds(df.groupBy(trial).agg(F.max(y).alias(y)), trial, y, k, seed).select(trial, "fold")
    windows = sequence_windows(df, axis, cols, y, length, step, horizon)
    windows = cut(windows.join(folds, trial))
    out = []
    for fold in range(k):
        train, test = sampling.take_fold(windows, fold, k)
        pred = window_scores(fit_window_logistic(train), test, threshold)
        out.append(binary_metrics(pred, "label", "p").withColumns(
            {"model": F.lit("LogRegTS"), "fold": F.lit(fold), "horizon": F.lit(horizon)}))
    return stack(out)


def classifier_matrix(df: DataFrame, axis: Axis, name: str, cols: Sequence[str], y: str, unit: float = 1.0, method: str = "v1",
                      rate: str | None = None, **sides) -> DataFrame:
    """Window features with the early mean, window length and stride of a classifier (``WINDOWING``), and ``window_id``.

    ``unit`` is a second in units of the axis; ``sides`` go to the baseline.
    """
    w = WINDOWING[name]
    based = baseline(df, method, cols, axis, window=w["early"] * unit, **sides)
    made = feature_matrix(based, axis, Slide(w["length"] * unit, w["stride"] * unit), [f"{c}_{method}" for c in cols], y, rate)
    return made.withColumn("window_id", F.xxhash64(*axis.keys, "window"))


def cross_validate_signals(df: DataFrame, axis: Axis, cols: Sequence[str], y: str, models: Sequence[str], unit: float = 1.0,
                           method: str = "v1", rate: str | None = None, sides: Mapping[str, object] | None = None, **options) -> DataFrame:
    """From samples to fold results, every classifier on windows of its own; windows with a missing feature are left out.

    Whole trials go to a fold. ``options`` are those of ``cross_validate``.
    """
    out = []
    for name in models:
        made = classifier_matrix(df, axis, name, cols, y, unit, method, rate, **(sides or {}))
        names = [c for c in made.columns if c not in (*axis.keys, "window", "window_id", y)]
        ready = cut(drop_null_rows(made, [*names, y]))
        out.append(cross_validate(ready, "window_id", names, y, [name], group=axis.keys[0], **options))
    return stack(out)


# Search ranges of the sequence model; the threshold is read off the curve of each candidate.
SEQUENCE_SPACE = {"method": ("pick", [0, 1, 2, 3, 4, 5]), "length": ("int", 25, 250), "step": ("int", 25, 75)}


def tune_seq(df: DataFrame, axis: Axis, cols: Sequence[str], y: str, n: int = 30, horizon: int = 0, seed: int = 42,
             space: Mapping[str, tuple] | None = None, holdout: float = 0.2) -> tuple[dict, float]:
    """(baseline method, length, step and threshold with the best F1 of class 1 on held-out trials, that F1).

    Every candidate is fitted once; its scores are counted by bin, and one job finds the best threshold of all candidates.
    """
    trial = axis.keys[0]
    parts = sampling.group_holdout(df.select(trial).distinct(), trial, holdout, seed).select(trial, "is_test")
    sets, curves = candidates(space or SEQUENCE_SPACE, n, seed), []
    for i, p in enumerate(sets):
        names = preferred_names(cols, p["method"])
        if not names:
            continue
        windows = cut(sequence_windows(df, axis, names, y, p["length"], p["step"], horizon).join(parts, trial))
        train = windows.where("is_test = 0")
        if train.select("label").distinct().count() < 2:
            continue
        scored_ = window_scores(fit_window_logistic(train), windows.where("is_test = 1"))
        curves.append(cut(threshold_curve(scored_, y="label").withColumn("candidate", F.lit(i))))
    if not curves:
        raise ValueError("no candidate has columns and windows of both classes")
    best = best_threshold(stack(curves), ["candidate"]).orderBy(F.col("f1").desc(), "candidate").first()
    return {**sets[best["candidate"]], "threshold": best["threshold"]}, float(best["f1"])


def cross_validate_seq_tuned(df: DataFrame, axis: Axis, cols: Sequence[str], y: str, k: int = 5, n: int = 30, step: int = 10,
                             horizon: int = 0, seed: int = 42, space: Mapping[str, tuple] | None = None) -> DataFrame:
    """Per fold of whole trials: search on the training trials, refit with the columns, length and threshold found, metrics.

    Test windows start every ``step`` rows, whatever step the search found for training.
    """
    trial = axis.keys[0]
    folds = sampling.group_folds(df.groupBy(trial).agg(F.max(y).alias(y)), trial, y, k, seed).select(trial, "fold")
    placed, out = cut(df.join(folds, trial)), []
    for fold in range(k):
        train, test = sampling.take_fold(placed, fold, k)
        best, _ = tune_seq(train, axis, cols, y, n, horizon, seed, space)
        names = preferred_names(cols, best["method"])
        model = fit_window_logistic(cut(sequence_windows(train, axis, names, y, best["length"], best["step"], horizon)))
        pred = window_scores(model, sequence_windows(test, axis, names, y, best["length"], step, horizon), best["threshold"])
        out.append(binary_metrics(pred, "label", "p").withColumns(
            {"model": F.lit("LogRegTS"), "fold": F.lit(fold), "horizon": F.lit(horizon), **{c: F.lit(v) for c, v in best.items()}}))
    return stack(out)


def ablate(df: DataFrame, id_col: str, groups: Mapping[str, Sequence[str]], y: str, models: Sequence[str], k: int,
           seed: int = 42, params: Mapping[str, Mapping] | None = None, stored: str | None = None) -> DataFrame:
    """Stream groups x models x folds on one cached, folded table; keyed (grp, model, fold).

    With ``stored`` the parameters of every model are those of its median fold in that folder (``store.write_median``);
    a model without a file there is an error.
    """
    if stored:
        kept = read_median(df.sparkSession, stored)
        if missing := [m for m in models if m not in kept]:
            raise FileNotFoundError(f"no median parameters of {', '.join(missing)} in {stored}")
        params = {m: kept[m]["best_params"] for m in models}
    everything = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    folded = cut(sampling.stratified_folds(df.select(id_col, y, *everything), id_col, y, k, seed))
    out = []
    for grp, cols in groups.items():
        for name in models:
            for fold in range(k):
                train, test = sampling.take_fold(folded, fold, k)
                pred = scored(name, train, test, id_col, cols, y, (params or {}).get(name))
                out.append(binary_metrics(pred, y, "p").withColumns(
                    {"grp": F.lit(grp), "model": F.lit(name), "fold": F.lit(fold)}))
    return stack(out)


def horizon_sweep(df: DataFrame, axis: Axis, cols: Sequence[str], y: str, horizons: Sequence[int], k: int = 3,
                  length: int = 25, step: int = 10, seed: int = 42) -> DataFrame:
    """Refit and evaluate per forecast horizon and fold."""
    df = cut(df.select(*axis.keys, *axis.order, *[c for c in dict.fromkeys([*cols, y]) if c not in axis.order]))
    return stack([cross_validate_seq(df, axis, cols, y, k, length, step, 0.5, h, seed) for h in horizons])


def offset_sweep(df: DataFrame, axis: Axis, slide: Slide, y: str, offsets: Sequence[float]) -> DataFrame:
    """Window labels for every label offset, with an ``offset`` column."""
    made = []
    for o in offsets:
        moved = Slide(slide.length, slide.stride, slide.start, o)
        made.append(sliding_label(df, axis, moved, y).withColumn("offset", F.lit(o)))
    return stack(made)


def imbalance_study(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], y: str,
                    models: Sequence[str], seed: int = 42) -> DataFrame:
    """Every resampling variant, alone and with class weights, scored by every model.

    KNN and LDA take no class weights; for them there are no rows of that kind.
    """
    def fresh(df: DataFrame) -> DataFrame:
        return df.withColumn(id_col, F.xxhash64(F.col(id_col), F.col("copy"))).drop("copy")

    base = cut(train.select(id_col, y, *cols))
    variants = {
        "none": base,
        "rus": cut(sampling.undersample(base, id_col, y, seed)),
        "ros": cut(fresh(sampling.oversample(base, id_col, y, seed))),
        "smote": cut(fresh(sampling.smote(base, id_col, y, cols, seed=seed))),
        "smote_rus": cut(sampling.undersample(fresh(sampling.smote(base, id_col, y, cols, seed=seed)), id_col, y, seed)),
    }
    out = []
    for variant, data in variants.items():
        for name in models:
            for balanced in (False, True):
                if balanced and name not in WEIGHTED:
                    continue
                pred = scored(name, data, test, id_col, cols, y, balanced=balanced)
                label = f"{variant}+weights" if balanced else variant
                out.append(binary_metrics(pred, y, "p").withColumns({"variant": F.lit(label), "model": F.lit(name)}))
    return stack(out)


def reduction_study(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], y: str,
                    models: Sequence[str], n: int = 10, seed: int = 42,
                    alphas: Sequence[float] = selection.ALPHAS) -> DataFrame:
    """Every reduction method, scored by every model; keyed (method, model)."""
    train, test = cut(train.select(id_col, y, *cols)), cut(test.select(id_col, y, *cols))
    probe = fit("LogReg", train, cols, y)
    picks = {
        "none": list(cols),
        "lasso": selection.select_lasso(train, id_col, cols, y, alphas, seed),
        "enet": selection.select_enet(train, id_col, cols, y, alphas, seed=seed),
        "ridge": selection.select_ridge(train, id_col, cols, y, 100.0 * n / len(cols), alphas, seed),
        "mrmr": selection.select_mrmr(train, cols, y, n),
        "target_mean": selection.select_target_mean(train, cols, y, 5, 0.6),
        "single": selection.select_single_auc(train, cols, y, 0.6),
        "shuffle": selection.select_permutation(probe, train, id_col, cols, y, seed=seed),
    }
    out = []
    for method, names in picks.items():
        for name in models if names else []:
            pred = scored(name, train, test, id_col, names, y)
            out.append(binary_metrics(pred, y, "p").withColumns(
                {"method": F.lit(method), "model": F.lit(name), "n_features": F.lit(len(names))}))
    (a, b), m = selection.reduce_pca(train, cols, None, test, id_col=id_col, seed=seed)
    names = [f"pc{i}" for i in range(m)]
    flat = lambda d: d.select(id_col, y, *[F.get("pca", i).alias(n_) for i, n_ in enumerate(names)])
    for name in models:
        out.append(binary_metrics(scored(name, flat(a), flat(b), id_col, names, y), y, "p").withColumns(
            {"method": F.lit("pca"), "model": F.lit(name), "n_features": F.lit(m)}))
    return stack(out)
