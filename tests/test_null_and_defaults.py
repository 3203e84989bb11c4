"""NULL keys and times, decimal window bounds, default penalties, and a label that depends on the columns."""

import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from trialspan.functions.exprs import hash_key, hash_uniform
from trialspan.functions.sizing import attach
from trialspan.functions.timeline import neighbours, positions, running, time_axis
from trialspan.operators import sampling, selection, windows
from trialspan.plans import models


def rows(spark):
    made = [(None if i % 3 == 0 else "a", None if i % 11 == 0 else float(i), i) for i in range(400)]
    return made, spark.createDataFrame(made, "trial_id string, t_s double, sample_id long")


def test_null_keys_and_times(spark):
    made, df = rows(spark)
    axis = time_axis(block=40.0)
    want = {}
    for key in (None, "a"):
        own = sorted((r for r in made if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: k for k, r in enumerate(own)}
    assert {r.sample_id: r.pos for r in positions(df, axis).collect()} == want
    got = running(df, axis, {"n": ("total", F.lit(1)), "top": ("max", F.col("sample_id"))}).collect()
    assert all(r.n == (134 if r.trial_id is None else 266) and r.top >= r.sample_id for r in got)
    ends = [r for r in neighbours(df, axis, ["sample_id"]).collect() if r["__prev1_sample_id"] is None]
    assert {r.sample_id: want[r.sample_id] for r in ends} == {r.sample_id: 0 for r in ends} and len(ends) == 2


def test_null_class_ranks(spark):
    made, df = rows(spark)
    folds = sampling.stratified_folds(df, "sample_id", "trial_id", 5).collect()
    assert max(Counter(r.fold for r in folds if r.trial_id is None).values()) == 27  # 134 rows in 5 folds
    assert sampling.undersample(df, "sample_id", "trial_id").count() == 2 * 134


def test_attach_matches_null_keys(spark):
    _, df = rows(spark)
    n = df.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))
    for cells in (10_000, 0):  # broadcast and shuffled
        assert attach(df, n, ["trial_id"], max_cells=cells).where("n is null").count() == 0
    assert attach(df, n.where("trial_id is null"), ["trial_id"], "left_anti").count() == 266


def test_windows_on_decimal_bounds(spark):
    for hz, length, stride in ((25, 1.0, 0.1), (10, 1.0, 0.1), (25, 0.4, 0.04), (4, 2.5, 0.25)):
        made = [("a", i / hz, i) for i in range(300)]
        df = spark.createDataFrame(made, "trial_id string, t_s double, sample_id long")
        got = windows.sliding_stats(df, time_axis(), windows.Slide(length, stride), ["sample_id"]).collect()
        w, s = Fraction(str(length)), Fraction(str(stride))
        for r in got:
            own = [i for i in range(300) if r.window * s <= Fraction(i, hz) < r.window * s + w]
            assert (r.sample_id_max, r.sample_id_range) == (own[-1], own[-1] - own[0])
        assert len(got) == Fraction(299, hz) // s - (w // s - 1)


def test_uniform_has_more_than_32_bits(spark):
    u = [r[0] for r in spark.range(2000).select(hash_uniform(hash_key("id"))).collect()]
    assert len(set(u)) == 2000 and any((x * 2 ** 32) % 1 for x in u) and abs(sum(u) / 2000 - .5) < .03


def test_default_penalty_learns_and_importance_shows(spark):
    rng = random.Random(1)
    made = []
    for i in range(2000):
        y = int(i % 20 == 0)
        made.append((i, y, rng.gauss(2.5 * y, 1), rng.gauss(0, 1)))
    df = spark.createDataFrame(made, "id long, y int, signal double, noise double")
    for name in ("LogReg", "SVM"):
        model = models.fit(name, df, ["signal", "noise"], "y")
        assert model.stages[-1].coefficients[0] > .8
    drop = {r.feature: r.drop for r in selection.permutation_importance(
        models.fit("LogReg", df, ["signal", "noise"], "y"), df, "id", ["signal", "noise"], "y").collect()}
    assert drop["signal"] > .1 > abs(drop["noise"])
