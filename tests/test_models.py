"""Searches, class weights, stored parameters and the sequence model's search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.functions.timeline import time_axis
from trialspan.operators import metrics as mt
from trialspan.operators import sampling
from trialspan.operators.catalog import preferred_names
from trialspan.plans import experiments as ex
from trialspan.plans import models
from trialspan.sources import store


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 3))
    y = (x[:, 0] + x[:, 1] + .4 * rng.normal(size=160) > 1.0).astype(int)
    made = [(i, int(y[i]), *map(float, x[i])) for i in range(160)]
    return spark.createDataFrame(made, "id long, y int, a double, b double, c double").repartition(3).cache()


def test_candidates_come_from_the_ranges():
    for name, space in models.SPACES.items():
        sets = models.candidates(space, 20, 1)
        assert sets == models.candidates(space, 20, 1) and len({str(s) for s in sets}) == len(sets)
        for s in sets:
            for k, (kind, *spec) in space.items():
                assert s[k] in spec[0] if kind == "pick" else spec[0] <= s[k] <= spec[1]
                assert kind != "int" or isinstance(s[k], int)
    assert len(models.candidates({"a": ("pick", [1, 2]), "b": ("int", 3, 4)}, 99)) == 4
    assert models.candidates({"a": ("log", 1e-4, 1e2)}, 9) != models.candidates({"a": ("log", 1e-4, 1e2)}, 9, 7)


def test_neighbour_search_equals_votes(rows):
    folded = sampling.stratified_folds(rows, "id", "y", 3, 42).cache()
    space = {"k": ("int", 3, 6), "weights": ("pick", ["uniform", "distance"]), "p": ("int", 1, 2)}
    got = {(r["p"], r["weights"], r["k"]): r["f1"] for r in models.search_neighbours(folded, "id", ["a", "b", "c"], "y", 3, "fold", space).collect()}
    assert len(got) == 16
    data = [(r["fold"], r["id"], r["y"], np.array([r["a"], r["b"], r["c"]])) for r in folded.collect()]
    for (p, weights, k), f1 in got.items():
        marks = []
        for f in range(3):
            tp = fp = fn = 0
            for _, _, y, v in (d for d in data if d[0] == f):
                near = sorted((float((np.abs(w - v) ** p).sum() ** (1 / p)), i, z) for g, i, z, w in data if g != f)[:k]
                w = [1.0 if weights == "uniform" else 1.0 / d for d, _, _ in near]
                hit = sum(a * z for a, (_, _, z) in zip(w, near)) / sum(w) > 0.5
                tp, fp, fn = tp + (hit and y == 1), fp + (hit and y != 1), fn + (not hit and y == 1)
            marks.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        assert f1 == pytest.approx(np.mean(marks))
    model, params, f1 = models.tune("KNN", folded, ["a", "b", "c"], "y", folds=3, fold_col="fold", id_col="id", space=space)
    assert f1 == pytest.approx(max(got.values())) and got[params["p"], params["weights"], params["k"]] == pytest.approx(f1)
    assert models.predict(model, rows.select("id", "y", "a", "b", "c")).where("p = y").count() > 120
    with pytest.raises(ValueError):
        models.tune("KNN", rows, ["a"], "y")


def test_class_weights_reach_the_search(rows):
    few = rows.where("y = 0 or id % 3 = 0")
    cols, space = ["a", "b", "c"], {"C": ("pick", [1.0]), "l1_ratio": ("pick", [0.0])}
    plain, _, _ = models.tune("LogReg", few, cols, "y", 1, 2, space=space)
    even, _, _ = models.tune("LogReg", few, cols, "y", 1, 2, space=space, balanced=True)
    hits = lambda m: models.predict(m, few).where("p = 1").count()
    assert hits(even) > hits(plain)


def test_cross_validation_searches_neighbours(rows):
    out = ex.cross_validate(rows, "id", ["a", "b", "c"], "y", ["KNN"], k=2, alphas=[1e-3], resample=False, trials=2).collect()
    assert [r["fold"] for r in out] == [0, 1] and all(r["f1"] > 0.5 and "k" in r["best_params"] for r in out)


def test_ablation_takes_stored_parameters(spark, rows, tmp_path):
    path = str(tmp_path / "median")
    results = ex.stack([mt.binary_metrics(rows.select("y", F.lit(v).alias("p")), "y", "p").withColumns(
        {"model": F.lit("LogReg"), "fold": F.lit(f), "best_params": F.create_map(F.lit("C"), F.lit(str(c))), "selected_features": F.array(F.lit("a"))})
        for f, (v, c) in enumerate([(1, 0.5), (0, 2.0), (1, 8.0)])])
    store.write_median(results, path)
    kept = store.read_median(spark, path)
    assert kept["LogReg"]["best_params"] == {"C": 0.5} and kept["LogReg"]["fold_id"] == 0 and kept["LogReg"]["selected_features"] == ["a"]
    assert ex.ablate(rows, "id", {"ab": ["a", "b"]}, "y", ["LogReg"], 2, stored=path).count() == 2
    with pytest.raises(FileNotFoundError, match="RF"):
        ex.ablate(rows, "id", {"ab": ["a", "b"]}, "y", ["LogReg", "RF"], 2, stored=path)


def test_preferred_names():
    names = ["hr_v0", "hr_v1", "eeg_v0", "gsr_v2", "gsr_v0", "ecg_v7", "ecg_v5", "raw"]
    assert preferred_names(names, 0) == ["hr_v0", "eeg_v0", "gsr_v0"]
    assert preferred_names(names, 1) == ["hr_v1", "eeg_v0", "gsr_v0"]
    assert preferred_names(names, 2) == ["hr_v0", "eeg_v0", "gsr_v2"]
    assert preferred_names(names, 3) == ["hr_v1", "eeg_v0", "gsr_v0", "ecg_v7"]
    assert preferred_names(names, 5) == names


def test_threshold_curve_equals_all_scores(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.random(), .25, .5, 1.0, 0.0]), rng.randrange(2)) for k in (1, 2) for _ in range(200)] + [(3, .7, 0)]
    df = spark.createDataFrame(rows, "k int, score double, label int")
    got = {(r["k"], round(r["threshold"] * 100)): (r["tp"], r["fp"], r["fn"]) for r in mt.threshold_curve(df, ["k"], bins=100).collect()}
    assert set(got) == {(k, t) for k in (1, 2, 3) for t in range(10, 91)}
    for (k, t), counts in got.items():
        mine = [(s * 100 >= t, y) for g, s, y in rows if g == k]
        assert counts == (sum(h and y for h, y in mine), sum(h and not y for h, y in mine), sum(not h and y for h, y in mine))
    assert mt.best_threshold(mt.threshold_curve(df, ["k"], bins=100), ["k"]).where("k = 3").first()["threshold"] == 0.1


def test_sequence_search(spark):
    """The search keeps whole trials apart and finds columns that carry the label."""
    rng = np.random.default_rng(4)
    rows = []
    for trial in range(12):
        y = np.repeat([0, 1, 0], 20)
        for i in range(60):
            rows.append((trial, float(i), i, int(y[i]), float(rng.normal()), float(y[i] * 3 + rng.normal() * .3)))
    df = spark.createDataFrame(rows, "trial_id long, t_s double, sample_id long, y int, s_v0 double, s_v1 double")
    space = {"method": ("pick", [0, 1]), "length": ("int", 4, 6), "step": ("int", 2, 3)}
    best, f1 = ex.tune_seq(df, time_axis(block=20.0), ["s_v0", "s_v1"], "y", 5, space=space)
    assert best["method"] == 1 and f1 > 0.9 and 0.1 <= best["threshold"] <= 0.9
    out = ex.cross_validate_seq_tuned(df, time_axis(block=20.0), ["s_v0", "s_v1"], "y", 2, 4, 3, space=space).collect()
    assert len(out) == 2 and all(r["f1"] > 0.8 and r["method"] == 1 for r in out)


def test_draws_with_replacement(spark):
    rows = [(i, 0) for i in range(50)] + [(100 + i, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, y int")
    got = sampling.oversample(df, "id", "y", 7, replacement=True).collect()
    assert sum(r["y"] == 1 for r in got) == sum(r["y"] == 0 for r in got) == 50
    times = [sum(r["id"] == 100 + i for r in got) for i in range(9)]
    assert min(times) >= 1 and len(set(times)) > 2  # uneven, as draws are
    again = sampling.oversample(df.repartition(3), "id", "y", 7, replacement=True).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_every_classifier_gets_its_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(t, .5 * i, i, int(40 <= i < 80), float(5 + (40 <= i < 80) * 2 + rng.normal() * .2), float(rng.normal() + 3)) for t in range(6) for i in range(120)]
    df = spark.createDataFrame(rows, "trial_id long, t_s double, sample_id long, y int, s double, n double")
    axis = time_axis(block=20.0)
    m = {name: ex.classifier_matrix(df, axis, name, ["s", "n"], "y").cache() for name in ("RF", "LDA")}
    from trialspan.operators.baseline import baseline
    from trialspan.operators.windows import Slide, feature_matrix

    plain = feature_matrix(baseline(df, "v1", ["s", "n"], axis, window=46.25), axis, Slide(15, 0.25), ["s_v1", "n_v1"], "y")
    assert m["LDA"].drop("window_id").exceptAll(plain.select(m["LDA"].drop("window_id").columns)).count() == 0
    assert m["RF"].count() > m["LDA"].count() and m["LDA"].select("window_id").distinct().count() == m["LDA"].count()
    out = ex.cross_validate_signals(df, axis, ["s", "n"], "y", ["LDA", "LogReg"], k=2, alphas=[1e-3], resample=False, balanced=True).collect()
    assert {(r["model"], r["fold"]) for r in out} == {(n, f) for n in ("LDA", "LogReg") for f in (0, 1)} and all(r["f1"] > 0.8 for r in out)
