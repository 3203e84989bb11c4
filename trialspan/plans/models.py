"""Classifiers on MLlib and their search."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import moments_by
from ..functions.sizing import attach
from ..operators.metrics import class_weights
from ..operators.neighbours import knn_classify, knn_join, vectors

# Early-mean window, window length and stride (s) per classifier.
WINDOWING = {
    "LogReg": {"early": 5, "length": 12.5, "stride": 0.25},
    "RF": {"early": 18.75, "length": 7.5, "stride": 0.25},
    "LDA": {"early": 46.25, "length": 15, "stride": 0.25},
    "SVM": {"early": 32.5, "length": 15, "stride": 0.25},
    "EGB": {"early": 46.25, "length": 12.5, "stride": 0.25},
    "KNN": {"early": 32.5, "length": 15, "stride": 0.25},
}
# Search ranges per classifier: ``log`` and ``real`` draw from an interval, ``int`` from whole numbers, ``pick`` from a list.
SPACES: dict[str, dict[str, tuple]] = {
    "LogReg": {"C": ("log", 0.01, 100.0), "l1_ratio": ("real", 0.0, 1.0)},
    "RF": {"numTrees": ("int", 10, 1000), "maxDepth": ("int", 3, 30), "impurity": ("pick", ["gini", "entropy"]),
           "featureSubsetStrategy": ("pick", ["sqrt", "log2"]), "minInstancesPerNode": ("int", 1, 4), "minWeightFractionPerNode": ("real", 0.0, 0.49)},
    "EGB": {"maxIter": ("int", 50, 1000), "stepSize": ("log", 0.01, 1.0), "maxDepth": ("int", 3, 20),
            "featureSubsetStrategy": ("pick", ["sqrt", "log2", "all"]), "minInstancesPerNode": ("int", 1, 4), "minWeightFractionPerNode": ("real", 0.0, 0.49)},
    "SVM": {"C": ("log", 0.1, 1000.0), "tol": ("log", 1e-6, 1e-2)},
    "LDA": {"shrinkage": ("pick", [0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0])},
    "KNN": {"k": ("int", 3, 30), "weights": ("pick", ["uniform", "distance"]), "p": ("int", 1, 2)},
}
WEIGHTED = ("LogReg", "RF", "EGB", "SVM")  # classifiers that take class weights


def estimator(name: str, label: str, params: Mapping, n_rows: int, weight: str | None = None):
    """MLlib estimator of a classifier name; ``C`` (1 if not given) becomes regParam = 1 / (C n) on the raw coefficients."""
    p = dict(params)
    common = {"featuresCol": "features", "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if name == "LogReg":
        return LogisticRegression(regParam=1.0 / (p.pop("C", 1.0) * max(1, n_rows)),
                                  elasticNetParam=p.pop("l1_ratio", 0.0), standardization=False, **common, **p)
    if name == "SVM":
        return LinearSVC(regParam=1.0 / (p.pop("C", 1.0) * max(1, n_rows)), standardization=False, **common, **p)
    if name == "RF":
        return RandomForestClassifier(seed=p.pop("seed", 42), **common, **p)
    if name == "EGB":
        return GBTClassifier(seed=p.pop("seed", 42), **common, **p)
    raise ValueError(f"unknown classifier: {name}")


def fit(name: str, df: DataFrame, cols: Sequence[str], y: str, params: Mapping | None = None,
        balanced: bool = False) -> PipelineModel:
    """Fit a classifier on columns; ``balanced`` weights classes by n / (2 n_c)."""
    params, label = dict(params or {}), "__label"
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias(label))
    if name == "LDA":
        return fit_lda(data, cols, label, **params)
    weight = None
    if balanced:
        weight = "__weight"
        data = attach(data, class_weights(data, label).select(label, F.col("weight").alias(weight)), [label])
    stages = [VectorAssembler(inputCols=list(cols), outputCol="features"),
              estimator(name, label, params, data.count(), weight)]
    return Pipeline(stages=stages).fit(data)


def lda_weights(data: DataFrame, cols: Sequence[str], label: str, shrinkage: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear discriminant, from the moments of both classes (one pass)."""
    parts = moments_by(data, cols, label)
    if set(parts) != {0, 1}:
        raise ValueError("the discriminant needs both classes")
    n, mu = {k: m.n for k, m in parts.items()}, {k: m.mean for k, m in parts.items()}
    pooled = (parts[0].scatter + parts[1].scatter) / (n[0] + n[1])
    pooled = (1 - shrinkage) * pooled + shrinkage * np.trace(pooled) / len(cols) * np.eye(len(cols))
    w = np.linalg.lstsq(pooled, mu[1] - mu[0], rcond=None)[0]
    return w, float(-0.5 * (mu[1] + mu[0]) @ w + np.log(n[1] / n[0]))


def fit_lda(data: DataFrame, cols: Sequence[str], label: str, shrinkage: float = 0.0) -> PipelineModel:
    """Linear discriminant: class means and the pooled covariance, then one d x d solve.

    The fitted model is a SQL expression, so scoring stays a dot product inside the plan.
    """
    w, b = lda_weights(data, cols, label, shrinkage)
    dot = " + ".join(f"`{c}` * {float(x)!r}D" for c, x in zip(cols, w)) + f" + {b!r}D"
    sql = (f"SELECT *, CASE WHEN __score > 0 THEN 1.0D ELSE 0.0D END AS prediction "
           f"FROM (SELECT *, {dot} AS __score FROM __THIS__)")
    return PipelineModel([SQLTransformer(statement=sql)])


def drawn(kind: str, *spec, rng: random.Random):
    """One value of a search range."""
    if kind == "log":
        lo, hi = spec
        return float(min(hi, max(lo, lo * (hi / lo) ** rng.random())))
    if kind == "real":
        return rng.uniform(*spec)
    return rng.randint(*spec) if kind == "int" else rng.choice(list(spec[0]))


def candidates(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """Distinct seeded random parameter sets; all of them if the space has no more."""
    rng, out = random.Random(seed), []
    sizes = [float("inf") if v[0] in ("log", "real") else v[2] - v[1] + 1 if v[0] == "int" else len(v[1]) for v in space.values()]
    while len(out) < min(n, math.prod(sizes)):
        one = {k: drawn(*v, rng=rng) for k, v in space.items()}
        if one not in out:
            out.append(one)
    return out


@dataclass(frozen=True)
class Neighbours:
    """Neighbour classifier with its training rows, used like a fitted model."""

    train: DataFrame
    id_col: str
    cols: Sequence[str]
    y: str
    params: Mapping

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        votes = knn_classify(self.train, df, self.id_col, self.cols, self.y, p.get("k", 5), p.get("weights", "uniform"), p.get("p", 2))
        votes = votes.select(F.col(self.id_col).alias("__id"), F.col("prediction").cast("double").alias("prediction"))
        return df.join(votes, F.col(self.id_col) == F.col("__id")).drop("__id")


def search_neighbours(df: DataFrame, id_col: str, cols: Sequence[str], y: str, folds: int = 3, fold_col: str = "fold",
                      space: Mapping[str, tuple] | None = None) -> DataFrame:
    """(p, weights, k, f1): mean F1 of class 1 over the folds for every k, both votes and every p.

    One neighbour list a fold and p, at the largest k; each k reads a prefix of it.
    """
    space = space or SPACES["KNN"]
    (_, least, most), (_, p_lo, p_hi) = space["k"], space["p"]
    out = []
    for p in range(p_lo, p_hi + 1):
        for f in range(folds):
            train, test = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
            near = knn_join(vectors(test, id_col, cols), vectors(train, id_col, cols), most, p)
            truth = test.select(F.col(id_col).alias("id"), F.col(y).cast("double").alias("truth"))
            labels = train.select(F.col(id_col).alias("rid"), F.col(y).cast("double").alias("y"))
            # a list is as long as the largest k
            upto = Window.partitionBy("id").orderBy("rank")
            whole = F.sum("y").over(upto) / F.count(F.lit(1)).over(upto)
            hits, hit_y = F.sum((F.col("dist") == 0).cast("int")).over(upto), F.sum(F.when(F.col("dist") == 0, F.col("y"))).over(upto)
            w = F.try_divide(F.lit(1.0), F.col("dist"))
            by_distance = F.when(hits > 0, hit_y / hits).otherwise(F.try_divide(F.sum(w * F.col("y")).over(upto), F.sum(w).over(upto)))
            votes = near.join(labels, "rid").select("id", F.col("rank").alias("k"), whole.alias("uniform"), by_distance.alias("distance"))
            votes = votes.where(F.col("k") >= least).join(truth, "id")
            # both votes are counted in one pass over the lists
            counts = []
            for kind in space["weights"][1]:
                hit, pos = F.col(kind) > 0.5, F.col("truth") == 1
                counts += [F.struct(F.lit(kind).alias("weights"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
                                    F.count_if(~hit & pos).alias("fn"))]
            marks = votes.groupBy("k").agg(F.array(*counts).alias("s")).select("k", F.inline("s"))
            out.append(marks.select(F.lit(p).alias("p"), "weights", "k", F.lit(f).alias("fold"),
                                    F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)).alias("f1")))
    return reduce(DataFrame.unionByName, out).groupBy("p", "weights", "k").agg(F.avg("f1").alias("f1"))


def tune(name: str, df: DataFrame, cols: Sequence[str], y: str, n: int = 30, folds: int = 3, seed: int = 42,
         fold_col: str | None = None, parallelism: int = 4, balanced: bool = False, id_col: str | None = None,
         space: Mapping[str, tuple] | None = None) -> tuple[PipelineModel | Neighbours, dict, float]:
    """Random search by cross-validated F1 of class 1: (best model, its parameters, its F1).

    ``balanced`` weights classes by n / (2 n_c) where the classifier takes weights. The neighbour classifier tries its
    whole space; it needs ``id_col`` and ``fold_col``.
    """
    label, space = "__label", space or SPACES[name]
    if name == "KNN":
        if not fold_col or not id_col:
            raise ValueError("tuning the neighbour classifier needs an id and a fold column")
        marks = search_neighbours(df, id_col, cols, y, folds, fold_col, space).orderBy(F.col("f1").desc(), "k", "p", F.col("weights").desc()).first()
        params = {"k": marks["k"], "weights": marks["weights"], "p": marks["p"]}
        return Neighbours(df.select(id_col, y, *[F.col(f"`{c}`") for c in cols]), id_col, list(cols), y, params), params, float(marks["f1"])
    keep = [fold_col] if fold_col else []
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias(label),
                     *[F.col(c).cast("int").alias(c) for c in keep])
    weight = "__weight" if balanced and name in WEIGHTED else None
    if weight:
        data = attach(data, class_weights(data, label).select(label, F.col("weight").alias(weight)), [label])
    data = data.persist()
    score = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    sets = candidates(space, n, seed)
    if name == "LDA":
        # not an MLlib estimator: score each candidate over the given folds
        if not fold_col:
            raise ValueError("tuning LDA needs a fold column")
        found = []
        for p in sets:
            marks = [score.evaluate(fit_lda(data.where(F.col(fold_col) != i), cols, label, **p)
                                    .transform(data.where(F.col(fold_col) == i))) for i in range(folds)]
            found.append((float(np.mean(marks)), p))
        best = max(found, key=lambda t: t[0])
        model = fit_lda(data, cols, label, **best[1])
        data.unpersist()
        return model, best[1], best[0]
    n_rows = data.count()
    est = estimator(name, label, {}, n_rows, weight)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features"), est])
    grid = []
    for p in sets:
        made = estimator(name, label, p, n_rows, weight)
        grid.append({est.getParam(q.name): made.getOrDefault(q) for q in made.params if made.isSet(q)
                     and q.name not in ("featuresCol", "labelCol", "weightCol", "seed")})
    extra = {"foldCol": fold_col} if fold_col else {}
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=score, numFolds=folds, seed=seed,
                        parallelism=parallelism, **extra)
    fitted = cv.fit(data)
    data.unpersist()
    i = int(np.argmax(fitted.avgMetrics))
    return fitted.bestModel, sets[i], float(fitted.avgMetrics[i])


def predict(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the predicted class and drop the ML columns."""
    ml = ("features", "rawPrediction", "probability", "__score")
    made = model.transform(df)
    return made.withColumn(out, F.col("prediction").cast("int")).drop("prediction", *ml)


def fit_window_logistic(windows: DataFrame, y: str = "label", params: Mapping | None = None):
    """Logistic regression over flattened sequence windows, balanced by class weights."""
    from ..operators.sequences import flatten_windows

    p = dict(params or {})
    data = flatten_windows(windows).withColumn("__label", F.col(y).cast("double"))
    data = attach(data, class_weights(data, "__label").select("__label", F.col("weight").alias("__weight")), ["__label"])
    return LogisticRegression(featuresCol="features", labelCol="__label", weightCol="__weight",
                              regParam=p.get("regParam", 0.01), elasticNetParam=p.get("l1_ratio", 0.0)).fit(data)


def window_scores(model, windows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability and thresholded class of each window."""
    from pyspark.ml.functions import vector_to_array

    from ..operators.clean import decide
    from ..operators.sequences import flatten_windows

    made = model.transform(flatten_windows(windows)).withColumn("score", F.get(vector_to_array("probability"), 1))
    return decide(made, "score", threshold, "p").drop("features", "rawPrediction", "probability", "prediction")
