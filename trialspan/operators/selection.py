"""Feature selection and reduction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..functions.moments import Moments, moments_by, together
from ..functions.sizing import attach_one
from ..functions.timeline import Axis, running, sorted_axis
from .metrics import rates
from .sampling import hash_ranks, stratified_folds

# The search range of the penalty (log-uniform) and of the mixing ratio.
ALPHAS = np.logspace(-5, 2, 50).tolist()
L1_RATIOS = [0.1, 0.5, 0.9]
# The range of the variance share that components may explain.
SHARES = [0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 0.999, 0.9995, 0.9999]


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in cols])))


def elastic_net(m: Moments, alpha: float, ratio: float, start: np.ndarray | None = None, tol: float = 1e-9, sweeps: int = 20_000) -> np.ndarray:
    """Coefficients that minimize 1/(2n) squared error + alpha (ratio l1 + (1 - ratio)/2 l2); the last column is the target.

    Coordinate descent on the d x d matrix; every coefficient's condition is met within ``tol`` of the scale of the gradients.
    """
    d = len(m.mean) - 1
    gram, target = m.scatter[:d, :d] / max(1, m.n), m.scatter[:d, d] / max(1, m.n)
    l1, l2, diag = alpha * ratio, alpha * (1.0 - ratio), np.diag(gram)
    if l1 == 0.0:
        return np.linalg.lstsq(gram + l2 * np.eye(d), target, rcond=None)[0]
    b = np.zeros(d) if start is None else start.copy()
    left, scale = target - gram @ b, max(float(np.abs(target).max(initial=0.0)), 1e-300)
    for _ in range(sweeps):
        worst = 0.0
        for j in np.flatnonzero(diag > 0):
            pull = left[j] + diag[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (diag[j] + l2)
            step = new - b[j]
            if step:
                left -= gram[:, j] * step
                b[j] = new
                worst = max(worst, abs(step) * (diag[j] + l2))
        if worst <= tol * scale:
            break
    return b


def r_squared(m: Moments, fitted: Moments, b: np.ndarray) -> float:
    """Share of a held-out target's variance that coefficients with the intercept of ``fitted`` explain."""
    d = len(b)
    intercept = fitted.mean[d] - fitted.mean[:d] @ b
    off = m.mean[d] - intercept - m.mean[:d] @ b
    error = m.scatter[d, d] - 2.0 * b @ m.scatter[:d, d] + b @ m.scatter[:d, :d] @ b + m.n * off * off
    return 1.0 - error / m.scatter[d, d] if m.scatter[d, d] > 0 else (1.0 if error <= 0 else 0.0)


def search_linear(folds: Sequence[Moments], alphas: Sequence[float], ratios: Sequence[float]) -> tuple[np.ndarray, float, float]:
    """(coefficients on all rows, alpha, ratio) with the best mean r squared over held-out folds.

    Every training set is the total without its fold; penalties go from large to small, each starting at the last solution.
    """
    total = together(folds, len(folds[0].mean))
    if len(alphas) * len(ratios) == 1:
        return elastic_net(total, alphas[0], ratios[0]), alphas[0], ratios[0]
    marks = {}
    for fold in folds:
        train = total - fold
        for r in ratios:
            b = None
            for a in sorted(alphas, reverse=True):
                b = elastic_net(train, a, r, b)
                marks.setdefault((a, r), []).append(r_squared(fold, train, b))
    best = max(((a, r) for a in alphas for r in ratios), key=lambda k: float(np.mean(marks[k])))
    return elastic_net(total, *best), *best


def fold_moments(df: DataFrame, id_col: str, cols: Sequence[str], y: str, seed: int = 42, k: int = 3) -> list[Moments]:
    """Moments of the columns and the target in each of k stratified folds, from one pass."""
    rows = df.select(F.col(id_col), F.col(y).cast("double").alias("__y"), F.col(y).alias("__c"), *[F.col(f"`{c}`") for c in cols])
    made = moments_by(stratified_folds(rows, id_col, "__c", k, seed), [*cols, "__y"], "fold")
    return [made[f] for f in sorted(made)]


def _linear(df: DataFrame, id_col: str, cols: Sequence[str], y: str, alphas: Sequence[float],
            ratios: Sequence[float], seed: int) -> np.ndarray:
    """Coefficients of the penalized regression that wins the 3-fold search."""
    return search_linear(fold_moments(df, id_col, cols, y, seed), list(alphas), list(ratios))[0]


def lasso_by_fold(folded: DataFrame, id_col: str, cols: Sequence[str], y: str, alphas: Sequence[float] = ALPHAS,
                  seed: int = 42, fold: str = "fold", inner: int = 3) -> dict[int, list[str]]:
    """Lasso selections on all rows but those of each fold, from one pass over (fold, inner fold)."""
    rows = folded.select(id_col, F.col(fold).alias("__outer"), F.col(y).cast("double").alias("__y"), F.col(y).alias("__c"), *[F.col(f"`{c}`") for c in cols])
    rows = stratified_folds(rows, id_col, "__c", inner, seed).withColumn("__cell", F.col("__outer") * inner + F.col("fold"))
    cells = moments_by(rows, [*cols, "__y"], "__cell")
    out = {}
    for f in sorted({c // inner for c in cells}):
        rest = [together((m for c, m in cells.items() if c // inner != f and c % inner == i), len(cols) + 1) for i in range(inner)]
        b = search_linear([m for m in rest if m.n], list(alphas), [1.0])[0]
        out[f] = [c for c, w in zip(cols, b) if w != 0]
    return out


def select_lasso(df: DataFrame, id_col: str, cols: Sequence[str], y: str, alphas: Sequence[float] = ALPHAS,
                 seed: int = 42) -> list[str]:
    """Columns with a non-zero lasso coefficient (objective 1/(2n) squared error + alpha l1)."""
    coef = _linear(df, id_col, cols, y, alphas, [1.0], seed)
    return [c for c, w in zip(cols, coef) if w != 0]


def select_enet(df: DataFrame, id_col: str, cols: Sequence[str], y: str, alphas: Sequence[float] = ALPHAS,
                ratios: Sequence[float] = L1_RATIOS, seed: int = 42) -> list[str]:
    coef = _linear(df, id_col, cols, y, alphas, ratios, seed)
    return [c for c, w in zip(cols, coef) if w != 0]


def select_ridge(df: DataFrame, id_col: str, cols: Sequence[str], y: str, n: float,
                 alphas: Sequence[float] = ALPHAS, seed: int = 42) -> list[str]:
    """Columns whose coefficient magnitude reaches percentile 100 - n."""
    size = np.abs(_linear(df, id_col, cols, y, alphas, [0.0], seed))
    cut_at = np.percentile(size, 100 - n)
    return [c for c, s in zip(cols, size) if s >= cut_at]


def optimality(df: DataFrame, cols: Sequence[str], y: str, b: np.ndarray, alpha: float, ratio: float) -> DataFrame:
    """(feature, weight, excess): by how much each coefficient misses its condition, measured on the rows.

    The gradient of the squared error is minus the covariance of the column with the residual; it has to equal the
    penalty's slope at a coefficient, and to stay within alpha times ratio at a zero one.
    """
    dot = reduce(lambda a, x: a + x, [F.col(f"`{c}`").cast("double") * float(w) for c, w in zip(cols, b) if w != 0], F.lit(0.0))
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)], (F.col(y).cast("double") - dot).alias("rest"))
    pulls = rows.agg(F.array(*[F.covar_pop(f"x{i}", "rest") for i in range(len(cols))]).alias("p"))
    told = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(float(w)).alias("weight")) for c, w in zip(cols, b)])
    each = pulls.select(F.inline(F.arrays_zip("p", told.alias("t")))).select("p", "t.feature", "t.weight")
    slope = F.col("weight") * alpha * (1.0 - ratio)
    return each.select("feature", "weight", F.when(F.col("weight") == 0, F.greatest(F.abs("p") - alpha * ratio, F.lit(0.0))).otherwise(
        F.abs(F.col("p") - slope - F.signum("weight") * alpha * ratio)).alias("excess"))


def components(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Variances and directions (columns) of the principal components, largest first; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(m.covariance())
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def components_for(values: np.ndarray, share: float) -> int:
    """The fewest components that explain ``share`` of the variance."""
    part = np.cumsum(values) / max(values.sum(), 1e-300)
    return min(int(np.searchsorted(part, share - 1e-12) + 1), len(values))


def component_likelihood(train: Moments, test: Moments, k: int) -> float:
    """Mean log-likelihood of held-out rows under the Gaussian whose first k components are free and whose others are alike."""
    values, vectors = components(train)
    d = len(values)
    noise = values[k:].mean() if k < d else 0.0
    spread = np.maximum(np.where(np.arange(d) < k, values, noise), 1e-300)
    apart = test.mean - train.mean
    second = test.scatter / max(1, test.n) + np.outer(apart, apart)
    fit = np.einsum("ij,ik,kj->j", vectors, second, vectors) / spread
    return float(-0.5 * (d * np.log(2.0 * np.pi) + np.log(spread).sum() + fit.sum()))


def tune_share(df: DataFrame, id_col: str, cols: Sequence[str], shares: Sequence[float] = SHARES, k: int = 3, seed: int = 42) -> tuple[float, int]:
    """(share, number of components) whose components give held-out folds the largest mean likelihood; one pass over the rows."""
    rows = df.select(id_col, F.lit(0).alias("__c"), *[F.col(f"`{c}`") for c in cols])
    made = moments_by(stratified_folds(rows, id_col, "__c", k, seed), cols, "fold")
    folds = [made[f] for f in sorted(made)]
    total = together(folds, len(cols))

    def mark(share: float) -> float:
        rest = [(total - f, f) for f in folds]
        return float(np.mean([component_likelihood(t, f, components_for(components(t)[0], share)) for t, f in rest]))

    best = max(shares, key=mark)
    return best, components_for(components(total)[0], best)


def reduce_pca(train: DataFrame, cols: Sequence[str], share: float | None, *others: DataFrame, id_col: str | None = None,
               seed: int = 42) -> tuple[list[DataFrame], int]:
    """Project onto the first components that explain ``share`` of the variance (array ``pca``).

    Without a share it is tuned on folds made by ``id_col``.
    """
    if share is None:
        share = tune_share(train, id_col, cols, seed=seed)[0]
    values, vectors = components(moments_by(train, cols)[0])
    k = components_for(values, share)
    w = np.ascontiguousarray(vectors[:, :k])

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype("float64") @ w) if len(v) else [])

    x = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    return [d.withColumn("pca", project(x)) for d in (train, *others)], k


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form (keep..., ``feature``, ``x``)."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return df.select(*keep, F.inline(parts))


def binned(df: DataFrame, cols: Sequence[str], y: str, bins: int) -> DataFrame:
    """Counts per (feature, equal-width bin): ``n`` rows and ``n1`` positives."""
    span = df.agg(*[x for c in cols for x in (F.min(c).cast("double").alias(f"__lo_{c}"),
                                              F.max(c).cast("double").alias(f"__hi_{c}"))])
    width = attach_one(df, span).select(F.col(y).alias("__y"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.least(F.floor(ratio((F.col(c) - F.col(f"__lo_{c}")) * bins,
                                                         F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), 0.0)),
                                           F.lit(bins - 1)).alias("bin")) for c in cols])))
    return width.where("bin is not null").groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__y") == 1).alias("n1"))


def mutual_information(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats between the binned feature and the binary label."""
    cells = binned(df, cols, y, bins)
    tot = cells.groupBy("feature").agg(F.sum("n").alias("__n"), F.sum("n1").alias("__n1"))

    def term(k, side):
        return F.when(k > 0, k / F.col("__n") * F.log(k * F.col("__n") / (F.col("n") * side))).otherwise(0.0)

    joined = cells.join(tot, "feature")
    return joined.groupBy("feature").agg(F.sum(
        term(F.col("n1"), F.col("__n1")) + term(F.col("n") - F.col("n1"), F.col("__n") - F.col("__n1"))).alias("mi"))


def covariance(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sample covariance (d x d); only matrices reach the driver."""
    return moments_by(df, cols).get(0, Moments.of(np.zeros((0, len(cols))))).covariance()


def select_mrmr(df: DataFrame, cols: Sequence[str], y: str, n: int, bins: int = 10) -> list[str]:
    """Greedy relevance / redundancy: MI over |corr(x, mean of the selected)| + 1e-6.

    MI comes from one grouping, all correlations from one covariance matrix (the covariance with
    a mean is the mean of covariances); the greedy loop runs on these d x d numbers.
    """
    mi = {r["feature"]: r["mi"] for r in mutual_information(df, cols, y, bins).collect()}
    rel = np.array([mi.get(c, 0.0) for c in cols])
    cov = covariance(df, cols)
    std = np.sqrt(np.diag(cov))
    chosen: list[int] = []
    while len(chosen) < min(n, len(cols)):
        red = np.zeros(len(cols))
        if chosen:
            with_mean = cov[:, chosen].mean(1)
            dev = np.sqrt(max(cov[np.ix_(chosen, chosen)].mean(), 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                red = np.abs(np.nan_to_num(with_mean / (std * dev)))
        score = rel / (red + 1e-6)
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
    return [cols[i] for i in chosen]


def permutation_importance(model, df: DataFrame, id_col: str, cols: Sequence[str], y: str, seed: int = 42,
                           prediction: str = "prediction") -> DataFrame:
    """(feature, drop): F1 loss when one column is shuffled.

    Every row is paired once with another row through two md5 rankings; each column is then
    replaced in turn and all variants are scored in one pass.
    """
    packed = df.select(id_col, F.col(y).alias("__y"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    a = hash_ranks(packed, id_col, (), f"{seed}:a", "__r")
    b = hash_ranks(packed, id_col, (), f"{seed}:b", "__r").select("__r", F.col("v").alias("w"))
    pairs = a.join(b, "__r")
    # variant -1 keeps the row as it is
    variants = pairs.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))))
    fed = variants.select("i", "__y", *[F.when(F.col("i") == j, F.get("w", F.lit(j))).otherwise(F.get("v", F.lit(j))).alias(c)
                                        for j, c in enumerate(cols)])
    scored = model.transform(fed)
    hit, pos = F.col(prediction) == 1, F.col("__y") == 1
    counts = scored.groupBy("i").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                                     F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    f1 = counts.select("i", rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["f1"].alias("f1"))
    base = f1.where("i = -1").select(F.col("f1").alias("__base"))
    names = F.array(*[F.lit(c) for c in cols])
    return attach_one(f1.where("i >= 0"), base).select(F.get(names, F.col("i")).alias("feature"),
                                                       (F.col("__base") - F.col("f1")).alias("drop"))


def select_permutation(model, df: DataFrame, id_col: str, cols: Sequence[str], y: str,
                       threshold: float | None = None, seed: int = 42) -> list[str]:
    """Columns whose drop exceeds the threshold (the mean drop if none is given)."""
    rows = permutation_importance(model, df, id_col, cols, y, seed).collect()
    drops = {r["feature"]: r["drop"] for r in rows}
    limit = float(np.mean(list(drops.values()))) if threshold is None else threshold
    return [c for c in cols if drops[c] > limit]


def feature_auc(long: DataFrame, feature: str = "feature", x: str = "x", y: str = "y") -> DataFrame:
    """Rank AUC of every feature of a long table; equal values count one half.

    Values are counted first, then cumulated over sort ranges of (feature, value).
    """
    counts = long.where(F.col(x).isNotNull()).groupBy(feature, x).agg(
        F.count_if(F.col(y) == 1).alias("__p"), F.count_if(F.col(y) != 1).alias("__q"))
    return _auc_of_counts(counts, feature, x)


def _auc_of_counts(counts: DataFrame, feature: str, x: str) -> DataFrame:
    ranged, axis = sorted_axis(counts, [feature, x])
    run = running(ranged, Axis((feature,), (x,), axis.block),
                  {"__below": ("sum", F.col("__q")), "__tp": ("total", F.col("__p")), "__tq": ("total", F.col("__q"))})
    area = F.col("__p").cast("double") * (F.col("__below") - F.col("__q") / 2.0)
    return run.groupBy(feature).agg(F.try_divide(F.sum(area), F.max("__tp").cast("double") * F.max("__tq")).alias("auc"))


def single_feature_auc(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """(feature, auc) with max(a, 1 - a) for every column."""
    auc = feature_auc(unpivot(df, cols, [F.col(y).alias("y")]))
    return auc.withColumn("auc", F.greatest("auc", 1 - F.col("auc")))


def select_single_auc(df: DataFrame, cols: Sequence[str], y: str, threshold: float) -> list[str]:
    rows = single_feature_auc(df, cols, y).where(F.col("auc") > threshold).collect()
    kept = {r["feature"] for r in rows}
    return [c for c in cols if c in kept]


def target_mean_auc(df: DataFrame, cols: Sequence[str], y: str, bins: int = 5) -> DataFrame:
    """(feature, auc) of the bin-wise mean label, equal-width bins."""
    cells = binned(df, cols, y, bins).withColumn("__enc", F.col("n1") / F.col("n"))
    counts = cells.groupBy("feature", "__enc").agg(F.sum("n1").alias("__p"), F.sum(F.col("n") - F.col("n1")).alias("__q"))
    return _auc_of_counts(counts, "feature", "__enc")


def select_target_mean(df: DataFrame, cols: Sequence[str], y: str, bins: int, threshold: float) -> list[str]:
    kept = {r["feature"] for r in target_mean_auc(df, cols, y, bins).where(F.col("auc") > threshold).collect()}
    return [c for c in cols if c in kept]


def selection_sweep(select: Callable[[float], list[str]], score: Callable[[list[str]], DataFrame],
                    sizes: Sequence[float]) -> DataFrame:
    """Score the selection of every size; ``score`` returns one metrics row."""
    out = None
    for n in sizes:
        names = select(n)
        row = score(names).withColumns({"n": F.lit(float(n)), "n_features": F.lit(len(names))})
        out = row if out is None else out.unionByName(row)
    return out


SWEEP_PERCENTS = list(range(10, 101, 10))
