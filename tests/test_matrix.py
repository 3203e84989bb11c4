"""Neighbours, imputation, sampling, metrics, selection and attribution on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.operators import attribution as at
from trialspan.operators import catalog as cat
from trialspan.operators import clean
from trialspan.operators import impute as im
from trialspan.operators import metrics as mt
from trialspan.operators import neighbours as nb
from trialspan.operators import sampling as sm
from trialspan.operators import selection as sel
from trialspan.plans import experiments as ex
from trialspan.plans import models


def brute(q, r, k, p, skip):
    out = {}
    for i, x in q.items():
        d = sorted(((np.abs(x - v).sum() if p == 1 else math.sqrt(((x - v) ** 2).sum())), j)
                   for j, v in r.items() if not (skip and i == j))
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("p,skip,pivots,ref_block,query_block",
                         [(2, True, 5, 7, 4), (1, False, 3, 1000, 1000), (2, False, 40, 3, 2), (2, True, 1, 10, 3)])
def test_knn_join_is_exact(spark, p, skip, pivots, ref_block, query_block):
    rng = np.random.default_rng(3)
    pts = {i: v for i, v in enumerate(np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(8, 0.1, (30, 3)),
                                                 np.zeros((10, 3))]))}  # clusters and exact copies
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in pts.items()], "id long, v array<double>")
    got = {}
    for r in nb.knn_join(df, df, 4, p, skip, pivots, ref_block, query_block).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["rid"])
    assert got == brute(pts, pts, 4, p, skip)


def test_knn_join_fewer_references_than_k(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id long, v array<double>")
    assert nb.knn_join(df, df, 7, skip_self=True).count() == 6
    assert nb.knn_join(df, df.where("id > 9"), 7).count() == 0


def test_knn_impute_matches_loops(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    x[rng.random(x.shape) < 0.15] = np.nan
    rows = [(i, int(i % 4 != 0), *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, train int, a double, b double, c double, d double")
    cols = list("abcd")
    train = np.array([r[1] for r in rows]) == 1
    filled = np.where(np.isnan(x), np.nanmean(x[train], axis=0), x)
    want = x.copy()
    for i in range(len(x)):
        refs = {j: filled[j] for j in range(len(x)) if train[j]}
        ids = brute({i: filled[i]}, refs, 3, 2, True)[i]
        for j in np.nonzero(np.isnan(x[i]))[0]:
            want[i, j] = filled[ids, j].mean()
    out = im.knn_impute(df, "id", cols, 3, "train", ref_block=6, query_block=4).orderBy("id").collect()
    np.testing.assert_allclose([[r[c] for c in cols] for r in out], want, atol=1e-12)


def test_selective_indicators(spark):
    rows = [(i, None if i % 2 else 1.0, 1.0, None if i < 1 else 2.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out, kept = im.selective_indicators(df, ["a", "b", "c"])
    assert kept == ["a"] and out.agg(F.sum("a_missing")).first()[0] == 30


@pytest.mark.parametrize("value,want", [(None, "pre_feature"), ("nonsense", "pre_feature"), (" None ", "none"),
                                        ("post_feature_KNN", "post_feature_knn"), (3, "pre_feature")])
def test_phase_fallback(value, want):
    assert im.resolve_phase(value) == want


def test_row_deletion_toy(spark):
    df = spark.createDataFrame([(1.0, None, 3.0, 1), (1.0, 2.0, 3.0, 1), (None, 2.0, 3.0, 2), (4.0, 5.0, 6.0, 2)],
                               "a double, b double, c double, t int")
    assert clean.drop_null_rows(df, ["a", "b", "c"]).count() == 2


def toy(spark, n_neg=30, n_pos=10, d=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i >= n_neg), *[float(v + (i >= n_neg)) for v in rng.normal(size=d)]) for i in range(n_neg + n_pos)]
    return spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"x{i} double" for i in range(d))), [
        f"x{i}" for i in range(d)]


def test_smote_grows_the_minority_inside_segments(spark):
    df, cols = toy(spark)
    out = sm.smote(df, "id", "y", cols, k=7)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 30, 1: 30}
    made = np.array([[r[c] for c in cols] for r in out.where("copy >= 0").collect()])
    base = np.array([[r[c] for c in cols] for r in df.where("y = 1").collect()])
    for m in made:  # on a segment between two minority points
        ok = any(abs(np.linalg.norm(m - a) + np.linalg.norm(m - b) - np.linalg.norm(a - b)) < 1e-9
                 for i, a in enumerate(base) for b in base[i + 1:])
        assert ok


def test_smote_minority_smaller_than_k(spark):
    df, cols = toy(spark, 12, 3)
    assert sm.smote(df, "id", "y", cols, k=7).where("y = 1").count() == 12


def test_folds_partition_rows_and_groups(spark):
    df, cols = toy(spark, 50, 25)
    df = df.withColumn("g", F.col("id") % 9)
    f = sm.stratified_folds(df, "id", "y", 5).groupBy("fold", "y").count().collect()
    assert sorted((r["fold"], r["y"], r["count"]) for r in f) == [(i, y, n) for i in range(5) for y, n in ((0, 10), (1, 5))]
    g = sm.group_folds(df, "g", "y", 3).select("g", "fold").distinct().collect()
    assert len(g) == 9 and {r["fold"] for r in g} == {0, 1, 2}
    train, test = sm.take_fold(sm.stratified_folds(df, "id", "y", 5), 2, 5)
    assert train.count() + test.count() == 75 and train.join(test, "id").count() == 0
    with pytest.raises(ValueError):
        sm.take_fold(df, 5, 5)
    with pytest.raises(ValueError):
        sm.stratified_folds(df, "id", "y", 1)


def test_sampling_is_stable_under_partitioning(spark):
    df, _ = toy(spark, 60, 20)
    a = {r["id"] for r in sm.undersample(df.repartition(7), "id", "y").collect()}
    assert a == {r["id"] for r in sm.undersample(df.coalesce(1), "id", "y").collect()} and len(a) == 40
    over = sm.oversample(df, "id", "y")
    assert {r["y"]: r["count"] for r in over.groupBy("y").count().collect()} == {0: 60, 1: 60}


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = mt.binary_metrics(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"], r["specificity"], r["g_mean"]) == (1.0, 0, 0, 0, 1.0, 0)


def test_upper_median_fold(spark):
    df = spark.createDataFrame([(0, 0.6, "a"), (1, 0.7, "b"), (2, 0.7, "c"), (3, 0.9, "d")], "fold int, f1 double, k string")
    r = mt.median_fold(df, ["k"]).first()
    assert (r["f1_median"], r["fold"], r["k"]) == (0.7, 1, "b")
    two = mt.median_fold(df.where("fold < 2"))
    assert two.first()["f1_median"] == 0.7
    s = {r["metric"]: r for r in mt.summarize_folds(df.where("fold < 2"), ["f1"]).collect()}
    assert s["f1"]["mean"] == pytest.approx(0.65) and s["f1"]["std"] == pytest.approx(0.05)


def test_stream_order_by_median(spark):
    df = spark.createDataFrame([("ECG", v) for v in (0.5, 0.6, 0.7)] + [("EEG+Pupil", v) for v in (0.8, 0.9, 0.7)],
                               "grp string, f1 double")
    assert [r["grp"] for r in mt.ablation_review(df).collect()] == ["EEG+Pupil", "ECG"]


def test_roc_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, score double")
    assert mt.roc_auc(df).first()[0] == pytest.approx(0.875)


def test_union_runs_needs_equal_names(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        mt.union_runs({"a": a, "b": b})


def test_streams_and_catalog(spark):
    names = ["HR (bpm) - Equivital_v0_mean_s1", "HR_instant - Equivital", "participant_HR_seated", "ECG Lead 1",
             "BR (rpm) - Equivital", "Pupil Difference [mm]"]
    c = spark.createDataFrame([(n,) for n in names], "feature string")
    got = lambda s: {r[0] for r in cat.select_streams(c, s).collect()}
    # the ECG patterns take every name of the belt; the word pattern of HR misses HR_instant
    assert got(["ECG"]) == {n for n in names if "Equivital" in n or "ECG" in n}
    assert got(["HR"]) == {names[0], names[2]}
    assert got([]) == set(names) and cat.normalize_streams([" gforce", "Centrifuge", "", "EEG"]) == ["Centrifuge", "EEG"]
    with pytest.raises(ValueError):
        cat.select_streams(c, ["Nope"])
    with pytest.raises(ValueError):
        cat.stream_columns(c, ["Strain"])
    assert len(cat.eeg_features("noAFE", True)) == 4 * 32 and len(cat.eeg_features("Complete", False)) == 11
    assert cat.catalog_frame(spark, "AFE", "Implicit").where("grp = 'rawEEG'").count() == 15


def test_shared_features(spark):
    sel_ = spark.createDataFrame([("KNN", "f1"), ("KNN", "f2"), ("RF", "f2"), ("RF", "f3"), ("LDA", "f2"), ("LDA", "f4")],
                                 "model string, feature string")
    assert [r[0] for r in cat.shared_features(sel_).collect()] == ["f2"]
    assert {(r["model"], r["feature"]) for r in cat.unshared_features(sel_).collect()} == {
        ("KNN", "f1"), ("RF", "f3"), ("LDA", "f4")}


def test_restrict_to(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, condition int")
    assert cat.restrict_to(df, ["b", "AFE"], renames={"AFE": "condition"}).columns == ["b", "condition"]
    with pytest.raises(ValueError):
        cat.restrict_to(df, ["zz"])


def test_lasso_and_ridge_keep_the_signal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    y = (x[:, 1] - 0.8 * x[:, 3] > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)],
                               "id long, y int, " + ", ".join(f"x{i} double" for i in range(5)))
    cols = [f"x{i}" for i in range(5)]
    assert set(sel.select_lasso(df, "id", cols, "y", [0.05])) == {"x1", "x3"}
    assert set(sel.select_ridge(df, "id", cols, "y", 40, [0.01])) == {"x1", "x3"}
    assert sel.select_mrmr(df, cols, "y", 2, 5)[0] in {"x1", "x3"}
    np.testing.assert_allclose(sel.covariance(df, cols), np.cov(x.T), atol=1e-9)
    lda = models.fit("LDA", df, cols, "y")
    m = mt.binary_metrics(models.predict(lda, df), "y", "p").first()
    assert m["f1"] > 0.9
    drops = {r["feature"]: r["drop"] for r in sel.permutation_importance(lda, df, "id", cols, "y").collect()}
    assert min(drops["x1"], drops["x3"]) > max(drops["x0"], drops["x2"], drops["x4"])


def test_shapley_sums_to_the_output(spark):
    df, cols = toy(spark)
    model = models.fit("LogReg", df, cols, "y")
    score = at.probability_score(model)
    out = at.shapley_permutation(score, df, df, "id", cols, 8, 5)
    sums = {r["row_id"]: (r["s"], r["b"]) for r in out.groupBy("row_id").agg(
        F.sum("shap").alias("s"), F.first("base_value").alias("b")).collect()}
    real = {r["id"]: r["score"] for r in score(df).collect()}
    assert len(sums) == 5
    for i, (s, b) in sums.items():
        assert s + b == pytest.approx(real[i])


def test_keyword_maps():
    assert len(at.keyword_map("channels_bands")) == 144 and at.keyword_map("raw_vs_psd")["Fz "] == "Fz_Raw"


def test_cross_validation_separates(spark):
    df, cols = toy(spark, 40, 40)
    out = ex.cross_validate(df, "id", cols, "y", ["LDA"], k=2, alphas=[1e-3], resample=False).collect()
    assert sorted(r["fold"] for r in out) == [0, 1] and all(r["n_train"] + r["n_val"] == 80 for r in out)
    assert all(r["f1"] > 0.6 for r in out)


def test_moments_add_and_subtract():
    from trialspan.functions.moments import Moments

    rng = np.random.default_rng(1)
    x = 1e7 + rng.normal(size=(90, 4))
    a, b = Moments.of(x[:30]), Moments.of(x[30:])
    whole = Moments.of(x)
    np.testing.assert_allclose((a + b).scatter, whole.scatter, rtol=1e-6)
    np.testing.assert_allclose((whole - a).scatter, b.scatter, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose((whole - a).mean, b.mean)
    assert (whole - whole).n == 0 and (Moments.of(x[:0]) + a).n == 30


def test_moments_of_missing_values(spark):
    from trialspan.functions.moments import moments_by

    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, x double")
    with pytest.raises(Exception, match="missing values in x"):
        moments_by(df, ["x"])
    assert moments_by(df.limit(0), ["x"]) == {}


def test_linear_search_equals_plain_search(spark):
    """The penalty chosen from moments is that of fitting and scoring every fold; coefficients equal MLlib's."""
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) * [1, 2, .5, 1, 3] + 4
    y = x[:, 0] - 2 * x[:, 2] + rng.normal(size=300)
    y = (y > np.median(y)).astype(int)
    cols = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(300)], "id long, y int, " + ", ".join(f"{c} double" for c in cols))
    alphas, ratios = [1e-3, 1e-2, 1e-1], [0.0, 0.5, 1.0]
    b, alpha, ratio = sel.search_linear(sel.fold_moments(df, "id", cols, "y"), alphas, ratios)
    folded = [(r["fold"], r["y"], [r[c] for c in cols]) for r in sel.stratified_folds(df, "id", "y", 3, 42).collect()]
    marks = {}
    for f in range(3):
        train, test = [r for r in folded if r[0] != f], [r for r in folded if r[0] == f]
        xt, yt = np.array([r[2] for r in train]), np.array([r[1] for r in train], float)
        xv, yv = np.array([r[2] for r in test]), np.array([r[1] for r in test], float)
        for a in alphas:
            for q in ratios:
                m = sel.Moments.of(np.column_stack([xt, yt]))
                w = sel.elastic_net(m, a, q)
                p = xv @ w + yt.mean() - xt.mean(0) @ w
                marks.setdefault((a, q), []).append(1 - ((yv - p) ** 2).sum() / ((yv - yv.mean()) ** 2).sum())
    assert (alpha, ratio) == max(marks, key=lambda k: np.mean(marks[k]))
    for a, q in ((0.02, 1.0), (0.05, 0.5), (0.1, 0.0)):
        # MLlib divides the squared part of the penalty by the deviation of the target
        l1, l2 = a * q, a * (1 - q) * y.std(ddof=1)
        want = LinearRegression(featuresCol="features", labelCol="y", standardization=False, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), tol=1e-10, maxIter=500).fit(
            sel.assemble(df, cols)).coefficients.toArray()
        np.testing.assert_allclose(sel.search_linear(sel.fold_moments(df, "id", cols, "y"), [a], [q])[0], want, atol=2e-4)


def test_lasso_by_fold_leaves_the_fold_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3))
    rows = [(i, i % 4, int(x[i, 0] + .1 * rng.normal() > 0), *map(float, x[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double")
    got = sel.lasso_by_fold(df, "id", ["a", "b", "c"], "y", [0.1])
    assert got == {f: sel.select_lasso(df.where(f"fold <> {f}"), "id", ["a", "b", "c"], "y", [0.1]) for f in range(4)} and "a" in got[0]


def test_tuned_component_share(spark):
    """Likelihoods from moments equal those of the Gaussian; the share follows the data's true rank."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 8)) * 5 + rng.normal(size=(400, 8)) * .3
    train, test = sel.Moments.of(x[:300]), sel.Moments.of(x[300:])
    values, vectors = sel.components(train)
    noise = values[3:].mean()
    c = vectors[:, :3] @ np.diag(values[:3] - noise) @ vectors[:, :3].T + noise * np.eye(8)
    z = x[300:] - x[:300].mean(0)
    want = np.mean([-0.5 * (8 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + r @ np.linalg.solve(c, r)) for r in z])
    assert sel.component_likelihood(train, test, 3) == pytest.approx(want)
    cols = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    share, k = sel.tune_share(df, "id", cols, [0.5, 0.95, 0.9999999])
    assert (share, k) == (0.95, 3) or k == 3
    (made,), m = sel.reduce_pca(df, cols, None, id_col="id")
    got = np.array([r["pca"] for r in made.orderBy("id").collect()])
    assert got.shape[1] == m and abs(np.cov(got.T) - np.diag(np.diag(np.cov(got.T)))).max() < 1e-8


def test_hashed_buckets(spark):
    """All references are indexed, the measured recall holds, and clustered rows need few probes."""
    from trialspan.operators import neighbours as nb

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12)) * 10
    x = centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 12))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    queries = v.where("id % 20 = 0")
    found = nb.knn_join(queries, v, 5, skip_self=True, mode="approx")
    exact = nb.knn_join(queries, v, 5, skip_self=True)
    row = nb.recall_of(found, exact).first()
    assert row["n_queries"] == 200 and row["recall"] >= 0.9
    b = nb.fit_buckets(nb.fold_copies(v, 6), queries, 4000, 6, 2, 0.95)
    assert b.directions.shape[1] == 6 and b.probes <= 8 and b.recall >= 0.95
    m = b.margins(x[:50])
    codes, score = b.ranked(m)
    assert (codes[:, 0] == b.code(m)).all() and (np.diff(score, axis=1) >= 0).all() and all(len(set(c)) == 64 for c in codes.tolist())
    # few rows, copies and no rows at all
    few = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert {(r["id"], r["rid"]) for r in nb.knn_join(few, few, 1, skip_self=True, mode="approx").collect()} == {(i, 0 if i else 1) for i in range(9)}
    assert nb.knn_join(few, few.limit(0), 1, mode="approx").count() == 0 == nb.knn_join(few.limit(0), few, 1, mode="approx").count()
    with pytest.raises(ValueError):
        nb.knn_join(few, few, 1, mode="other")


def test_column_quantiles_equal_numpy(spark, monkeypatch):
    """Brackets that hold, ties at their edges, few rows, one value, and a column without values."""
    from trialspan.operators.quality import column_quantiles

    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=5000), rng.integers(0, 3, 5000), rng.exponential(size=5000) ** 4, np.full(5000, 2.0)])
    df = spark.createDataFrame([(*map(float, r), None, float(r[0]) if i < 3 else None) for i, r in enumerate(x)],
                               "a double, b double, `c.1` double, d double, e double, f double").repartition(4)
    qs = [0.0, 0.25, 0.5, 0.751, 1.0]
    from trialspan.operators import quality
    for accuracy, most in ((1000, 1_000_000), (50, 1_000_000), (1000, 0)):
        monkeypatch.setattr(quality, "WINDOW_ROWS", most)
        got = {r["feature"]: [r[f"q{j}"] for j in range(5)] for r in column_quantiles(df, df.columns, qs, accuracy).collect()}
        for i, c in enumerate(["a", "b", "c.1", "d"]):
            np.testing.assert_allclose(got[c], np.quantile(x[:, i], qs), rtol=1e-12)
        np.testing.assert_allclose(got["f"], np.quantile(x[:3, 0], qs), rtol=1e-9)
        assert got["e"] == [None] * 5
    assert all(r["q0"] is None for r in column_quantiles(df.limit(0), ["a"], [0.5]).collect())


def test_rows_that_no_cell_excludes_are_visited_once(spark):
    """Rows without structure stay one cell; clustered ones visit few. Both are searched exactly, and large groups stay bounded."""
    rng = np.random.default_rng(11)
    flat, lumps = rng.normal(size=(400, 32)), np.repeat(rng.normal(size=(40, 2)) * 1e3, 500, axis=0) + rng.normal(size=(20000, 2))
    for x, visits in ((flat, 1.0), (lumps, 8.0)):
        df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>").cache()
        _, asked = nb._pivot_cells(nb.fold_copies(df, 4), df, len(x), 4, 2, None)
        assert len(x) <= asked.count() <= visits * len(x) and (visits == 1.0 or asked.select("cell").distinct().count() > 1)
    pts = dict(enumerate(flat))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in pts.items()], "id long, v array<double>")
    for p in (1, 2):
        got = {}
        for r in nb.knn_join(df, df, 4, p, True, ref_block=90, query_block=3).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["rid"])
        assert got == brute(pts, pts, 4, p, True)
    assert [nb.query_groups(n, 10) for n in (0, 1, 95, 250, 4000)] == [1, 1, 10, 24, 100]


def test_absolute_distances_in_tiles():
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(70, 5)), rng.normal(size=(2100, 5))
    assert np.allclose(nb.distances(a, b, 1), np.abs(a[:, None] - b[None]).sum(2), atol=1e-12)
    bar = nb.upper_kth(nb.distances(a, b, 1), 6)
    assert (np.sort(nb.distances(a, b, 1), axis=1)[:, 5:6] <= bar).all() and np.isfinite(bar).all()


@pytest.mark.parametrize("p,case", [(p, c) for p in (1, 2) for c in ("plain", "far", "ties", "outlier", "infinite", "few")])
def test_references_pass_queries_in_batches(p, case, monkeypatch):
    """Lists of batches are those of all references; the cheap distances leave few pairs, whatever the values are."""
    met, exact = [], nb._exact
    monkeypatch.setattr(nb, "_exact", lambda a, b, qi, *x: met.append(len(qi)) or exact(a, b, qi, *x))
    rng = np.random.default_rng(14)
    a, b, k = rng.normal(size=(70, 8)), rng.normal(size=(5 if case == "few" else 6000, 8)), 6
    if case == "far":
        a, b = a + 1e6, b + 1e6
    if case == "ties":
        a, b = np.rint(a), np.rint(b)
    if case == "outlier":
        b[17], b[4000, 3], a[2, 1] = 1e9, -1e12, 1e7
    if case == "infinite":
        b[17, 2] = np.inf
    lens = rng.integers(1, 4, len(b))
    ids = rng.permutation(lens.sum())
    search, begin = nb.Search(np.arange(70) * 2, a, k, p), np.r_[0, np.cumsum(lens)]
    for s in range(0, len(b), 700):
        e = min(s + 700, len(b))
        search.add(b[s:e], lens[s:e], ids[begin[s]:begin[e]])
    rows, near = search.found()
    assert rows.to_pylist() == list(range(0, 140, 2))
    for x, got in zip(a, near.to_pylist()):
        d = np.abs(x - b).sum(1) if p == 1 else np.sqrt(((x - b) ** 2).sum(1))
        d = np.repeat(d, lens)
        want = np.lexsort((ids, d))[:k]
        assert [g["rid"] for g in got] == ids[want].tolist() and [g["dist"] for g in got] == d[want].tolist()
    assert case not in ("plain", "far", "outlier") or sum(met) < 70 * 6000 / 8


def test_groups_give_one_list_a_query(spark, monkeypatch):
    """With enough groups of queries no block of references gives lists of its own."""
    lists, real = [], nb.nearest_lists
    monkeypatch.setattr(nb, "nearest_lists", lambda found, *a: lists.append(found.count()) or real(found, *a))
    pts = dict(enumerate(np.random.default_rng(15).normal(size=(300, 3))))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in pts.items()], "id long, v array<double>")
    got = {}
    for r in nb.knn_join(df, df, 4, 1, True, pivots=1, ref_block=20, query_block=3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["rid"])
    assert got == brute(pts, pts, 4, 1, True) and lists == [300]


def test_donors_in_batches(monkeypatch):
    """Donors that come in batches are those of all rows at once, also far from the origin, and few pairs are computed exactly."""
    rng, far, sure = np.random.default_rng(16), [], im._shared_distances
    x = rng.normal(size=(4000, 8)) + 1e4
    x[rng.random(x.shape) < 0.1] = np.nan
    x[20:30] = x[31]
    x[40], x[50:, 7] = np.nan, np.where(rng.random(3950) < 0.99, np.nan, x[50:, 7])
    at_once = im.Donors(np.arange(60), x[:60], 5)
    at_once.add(x, np.ones(4000, dtype=int), np.arange(4000))
    monkeypatch.setattr(im, "_shared_distances", lambda *a: far.append(len(a[2])) or sure(*a))
    search = im.Donors(np.arange(60), x[:60], 5)
    for s in range(0, 4000, 900):
        search.add(x[s:s + 900], np.ones(len(x[s:s + 900]), dtype=int), np.arange(s, min(s + 900, 4000)))
    told = [[c.to_pylist() for c in d.found()] for d in (search, at_once)]
    assert told[0] == told[1] and sum(far) < 60 * 4000 / 3
    for i, j, near in zip(*told[0]):
        diff = x[i] - x
        n = (~np.isnan(diff)).sum(1)
        dist = np.where(n > 0, np.sqrt(np.nansum(diff * diff, axis=1) * 8 / np.maximum(n, 1)), np.inf)
        want = [r for r in np.lexsort((np.arange(4000), dist)) if not np.isnan(x[r, j]) and np.isfinite(dist[r])][:5]
        assert [g["rid"] for g in near] == want and [g["value"] for g in near] == [x[r, j] for r in want]


def test_selective_imputation_gives_one_list_a_cell(spark, monkeypatch):
    """All rows pass each group of queries: a missing cell has one list, however many blocks of rows there are."""
    lists, real = [], im.nearest_lists
    monkeypatch.setattr(im, "nearest_lists", lambda found, *a: lists.append((found.count(), found.select("id", "dim").distinct().count())) or real(found, *a))
    monkeypatch.setattr(im.knn_impute_shared, "__defaults__", (5, False, 10, 2))
    rng = np.random.default_rng(17)
    rows = [(i, *[None if rng.random() < 0.2 else float(v) for v in rng.normal(size=3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    out, _ = im.impute_selective(df, "id", ["a", "b", "c"], scaled=True)
    assert out.count() == 120 and out.where("a is null or b is null or c is null").count() == 0
    assert lists[0][0] == lists[0][1] > 40


def test_donors_equal_loops(monkeypatch):
    """Nearest donors of every cell, also of columns that few or no rows hold and of queries that share nothing with a row."""
    import pandas as pd

    monkeypatch.setattr(im, "_CHUNK", 20_000)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 6)) + 50
    x[rng.random(x.shape) < 0.1] = np.nan
    x[3:, 4], x[:, 5] = np.where(rng.random(2997) < 0.99, np.nan, x[3:, 4]), np.nan
    x[7, 1:], x[8, :1] = np.nan, np.nan
    far, sure = 0, im._shared_distances

    def counted(*args):
        nonlocal far
        far += len(args[2])
        return sure(*args)

    monkeypatch.setattr(im, "_shared_distances", counted)
    frame = pd.DataFrame({"id": np.arange(3000), "v": list(x)})
    got = im._donor_block(frame.iloc[:60], frame.sample(frac=1, random_state=1), 4)
    want = []
    for i in range(60):
        diff = x[i] - x
        n = (~np.isnan(diff)).sum(1)
        dist = np.where(n > 0, np.sqrt(np.nansum(diff * diff, axis=1) * 6 / np.maximum(n, 1)), np.inf)
        for j in np.nonzero(np.isnan(x[i]))[0]:
            donors = [r for r in np.lexsort((np.arange(3000), dist)) if not np.isnan(x[r, j]) and np.isfinite(dist[r])][:4]
            want += [(i, j, r, x[r, j]) for r in donors]
    assert sorted(zip(got["id"], got["dim"], got["rid"], got["value"])) == sorted(want)
    # exact distances of a small part of the pairs
    assert far < 60 * 3000 / 3


def test_folds_without_a_column(spark):
    """A penalty that removes every column leaves the fold all of them."""
    df, cols = toy(spark, 40, 40)
    out = ex.cross_validate(df, "id", cols, "y", ["LDA", "KNN"], k=2, alphas=[1e6], resample=False).collect()
    assert sorted((r["model"], r["fold"]) for r in out) == [(m, f) for m in ("KNN", "LDA") for f in (0, 1)]
    assert all(r["selected_features"] == cols and r["n_train"] + r["n_val"] == 80 for r in out)
