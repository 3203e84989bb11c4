"""Blocked ordered operators against plain loops, for tiny, odd and huge blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.functions.timeline import fit_block, global_positions, neighbours, positions, running, time_axis
from trialspan.operators import baseline as bl
from trialspan.operators import events as ev
from trialspan.operators import sequences
from trialspan.operators import windows as win

BLOCKS = [0.5, 3.0, 1e9]


def frame(seed=1, sizes=(40, 1, 2, 25)):
    """Trials of uneven length with gaps, NULLs and repeated values."""
    rng, rows, sid = np.random.default_rng(seed), [], 0
    for trial, n in enumerate(sizes):
        t = np.cumsum(rng.choice([0.25, 0.25, 0.5, 7.0], n))
        for i in range(n):
            rows.append((trial, float(t[i]), sid, None if rng.random() < 0.2 else float(rng.integers(0, 9)),
                         str(rng.choice(["on", "off", "mark", "none"]))))
            sid += 1
    rng.shuffle(rows)
    rows = [(int(a), float(b), int(c), None if d is None else float(d), None if e == "none" else str(e))
            for a, b, c, d, e in rows]
    return rows


SCHEMA = "trial_id long, t_s double, sample_id long, v double, event string"


def trials(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def rows():
    return frame()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def by_id(out, col):
    return {r["sample_id"]: r[col] for r in out.collect()}


@pytest.mark.parametrize("block", BLOCKS)
def test_positions_and_running(df, rows, block):
    axis = time_axis(block=block)
    got = running(df, axis, {"pos": ("rows", F.lit(1)), "s": ("sum", F.coalesce("v", F.lit(0.0))), "m": ("max", F.col("v")),
                             "lo": ("min", F.col("v")), "l": ("last", F.col("v")), "n": ("total", F.lit(1))}).collect()
    got = {r["sample_id"]: r for r in got}
    assert len(got) == len(rows)
    for group in trials(rows).values():
        seen = []
        for i, r in enumerate(group):
            seen.append(r[3])
            present = [x for x in seen if x is not None]
            g = got[r[2]]
            assert g["pos"] == i + 1 and g["n"] == len(group)
            assert g["s"] == pytest.approx(sum(present))
            assert g["m"] == (max(present) if present else None) and g["lo"] == (min(present) if present else None)
            assert g["l"] == (present[-1] if present else None)
    assert by_id(positions(df, axis, "p"), "p") == {r[2]: i for g in trials(rows).values() for i, r in enumerate(g)}


@pytest.mark.parametrize("block", BLOCKS)
def test_neighbours(df, rows, block):
    got = {r["sample_id"]: r for r in neighbours(df, time_axis(block=block), ["v"], 3, 2).collect()}
    ids = lambda r, side, n: [r[f"__{side}{i}_sample_id"] for i in range(1, n + 1)]
    for g in trials(rows).values():
        s = [r[2] for r in g]
        for i, sid in enumerate(s):
            assert ids(got[sid], "prev", 3) == [s[i - k] if i - k >= 0 else None for k in (1, 2, 3)]
            assert ids(got[sid], "next", 2) == [s[i + k] if i + k < len(s) else None for k in (1, 2)]


@pytest.mark.parametrize("block", BLOCKS)
def test_gradient_matches_numpy(df, rows, block):
    full = df.withColumn("v", F.coalesce("v", F.lit(1.0)))
    out = bl.gradient(full, time_axis(block=block), ["v"], 2)
    d1, d2 = by_id(out, "v_derivative"), by_id(out, "v_2derivative")
    for g in trials(rows).values():
        t, v = np.array([r[1] for r in g]), np.array([1.0 if r[3] is None else r[3] for r in g])
        if len(g) == 1:
            assert d1[g[0][2]] is None and d2[g[0][2]] is None
            continue
        a = np.gradient(v, t)
        b = np.gradient(a, t)
        np.testing.assert_allclose([d1[r[2]] for r in g], a, atol=1e-9)
        np.testing.assert_allclose([d2[r[2]] for r in g], b, atol=1e-9)


@pytest.mark.parametrize("block", BLOCKS)
def test_interval_labels_pair_by_ordinal(df, rows, block):
    got = by_id(ev.label_intervals(df, time_axis(block=block), "on", "off"), "label")
    for g in trials(rows).values():
        on, off = [i for i, r in enumerate(g) if r[4] == "on"], [i for i, r in enumerate(g) if r[4] == "off"]
        want = np.zeros(len(g), int)
        for a, b in zip(on, off):
            want[a:b] = 1
        assert [got[r[2]] for r in g] == list(want)


@pytest.mark.parametrize("block", BLOCKS)
def test_until_shift_prelabel_ffill(df, rows, block):
    axis = time_axis(block=block)
    until = by_id(ev.label_until(df, axis, "on", "off"), "active")
    y = df.withColumn("label", (F.col("event") == "mark").cast("int")).na.fill(0, ["label"])
    shifted, pre = by_id(ev.shift_label(y, axis, 2), "label"), by_id(ev.prelabel(y, axis, 3), "label")
    filled = by_id(sequences.ffill(df, axis, ["v"]), "v")
    for g in trials(rows).values():
        ends = [i for i, r in enumerate(g) if r[4] == "off"]
        want = np.zeros(len(g), int)
        if ends:
            for i, r in enumerate(g):
                if r[4] == "on":
                    want[i:ends[0]] = 1
        assert [until[r[2]] for r in g] == list(want)
        lab = [int(r[4] == "mark") for r in g]
        assert [shifted[r[2]] for r in g] == (lab[2:] + [0, 0])[:len(g)]
        first = lab.index(1) if 1 in lab else None
        assert [pre[r[2]] for r in g] == [1 if first is not None and first - 3 <= i < first else x
                                          for i, x in enumerate(lab)]
        last, want = 0.0, []
        for r in g:
            last = r[3] if r[3] is not None else last
            want.append(last)
        assert [filled[r[2]] for r in g] == want
    assert ev.shift_label(y, axis, 0) is y


@pytest.mark.parametrize("block", BLOCKS)
def test_slot_in_overwrites_with_nulls_and_ignores_extra_rows(spark, df, rows, block):
    side = [(trial, float(i), i, None if i % 3 == 0 else 100.0 + i) for trial in (0, 2, 9) for i in range(30)]
    sdf = spark.createDataFrame(side, "trial_id long, k double, j long, v double")
    out = by_id(ev.slot_in(df, sdf, time_axis(block=block), time_axis("trial_id", "k", ("j",), block), "mark", ["v"]), "v")
    for trial, g in trials(rows).items():
        marks = [i for i, r in enumerate(g) if r[4] == "mark"]
        for i, r in enumerate(g):
            want = r[3]
            if trial in (0, 2) and marks and 0 <= i - marks[0] < 30:
                k = i - marks[0]
                want = None if k % 3 == 0 else 100.0 + k
            assert out[r[2]] == want


def naive_windows(g, slide):
    t = np.array([r[1] for r in g])
    n = int((t.max() - slide.offset) // slide.stride - (slide.length // slide.stride - 1))
    for j in range(max(n, 0)):
        b = slide.start + j * slide.stride
        yield j, [r for r in g if b <= r[1] < b + slide.length], [
            r for r in g if b + slide.offset <= r[1] < b + slide.offset + slide.length]


@pytest.mark.parametrize("slide", [win.Slide(3, 0.75), win.Slide(2.5, 1.0, 0, 1.25), win.Slide(4, 4, 1.0, 0.5),
                                   win.Slide(1, 3)])
@pytest.mark.parametrize("per_block", [2, 4096])
def test_sliding_features_match_loops(df, rows, slide, per_block, monkeypatch):
    monkeypatch.setattr(win, "WINDOWS_PER_BLOCK", per_block)
    y = df.withColumn("y", (F.col("event") == "on").cast("int")).na.fill(0, ["y"])
    out = win.sliding_features(y, time_axis(block=2.0), slide, ["v"], label="y", edges=["v"], pairs=["v"], pair_limit=2.0)
    got = {(r["trial_id"], r["window"]): r for r in out.collect()}
    n = 0
    for trial, g in trials(rows).items():
        for j, inside, later in naive_windows(g, slide):
            n += 1
            r = got[(trial, j)]
            vals = [x[3] for x in inside if x[3] is not None]
            near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
            assert near(r["v_mean"], np.mean(vals) if vals else None)
            assert near(r["v_stddev"], np.std(vals) if vals else None)
            assert near(r["v_max"], max(vals) if vals else None)
            assert near(r["v_range"], max(vals) - min(vals) if vals else None)
            assert r["y"] == int(any(x[4] == "on" for x in later))
            assert near(r["v_first"], inside[0][3] if inside else None)
            assert near(r["v_last"], inside[-1][3] if inside else None)
            d = [b[3] - a[3] for a, b in zip(inside, inside[1:]) if a[3] is not None and b[3] is not None]
            assert r["v_diff_n"] == len(d)
            assert near(r["v_diff_sum"], sum(d) if d else None) and near(r["v_diff_max"], max(d) if d else None)
            assert (r["v_diff_over"] or 0) == sum(abs(x) > 2 for x in d)
    assert n == len(got) and n > 5


def test_constant_signal_has_zero_deviation_and_z(spark):
    df = spark.createDataFrame([(1, i * 0.25, i, 1234567.1) for i in range(60)],
                               "trial_id long, t_s double, sample_id long, v double")
    w = win.sliding_stats(df, time_axis(block=2.0), win.Slide(3, 0.25), ["v"])
    assert {r[0] for r in w.select("v_stddev").collect()} == {0.0}
    z = win.standardize_windows(w, time_axis(), ["v_mean"])
    assert {(r["v_mean_s1"], r["v_mean_s2"]) for r in z.collect()} == {(0.0, None)}


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("horizon", [0, 3])
def test_sequence_windows(df, rows, block, horizon):
    y = df.withColumn("y", F.col("sample_id"))
    out = sequences.sequence_windows(y, time_axis(block=block), ["v", "t_s"], "y", 5, 3, horizon).collect()
    got = {(r["trial_id"], r["start"]): r for r in out}
    want = {}
    for trial, g in trials(rows).items():
        for s in range(0, len(g) - 5 - horizon + 1, 3):
            want[(trial, s)] = ([[r[3], r[1]] for r in g[s:s + 5]], g[s + 4 + horizon][2])
    assert {k: (r["rows"], r["label"]) for k, r in got.items()} == want


def test_v1_guards(spark):
    rows = [(1, 0.0, 0, 2.0, 0.0), (1, 1.0, 1, 4.0, 0.0), (1, 9.0, 2, 6.0, 5.0),
            (2, 0.0, 3, None, 1.0), (2, 9.0, 4, 3.0, 2.0), (3, 9.0, 5, 8.0, 3.0)]
    df = spark.createDataFrame(rows, "trial_id long, t_s double, sample_id long, a double, b double")
    axis = time_axis(block=1.0)
    got = {r["sample_id"]: (r["a_v1"], r["b_v1"]) for r in bl.baseline(df, "v1", ["a", "b"], axis, 5.0).collect()}
    # zero mean, a NULL in the window and an empty window all divide by 1
    assert got == {0: (2 / 3, 0.0), 1: (4 / 3, 0.0), 2: (2.0, 5.0), 3: (None, 1.0), 4: (3.0, 2.0), 5: (8.0, 3.0)}
    got = {r["sample_id"]: r["a_v2"] for r in bl.baseline(df, "v2", ["a"], axis, 5.0).collect()}
    assert got == {0: -1.0, 1: 1.0, 2: 3.0, 3: None, 4: 3.0, 5: 8.0}


def test_v4_without_marker_subtracts(spark):
    df = spark.createDataFrame([(1, 0.0, 0, 2.0, None), (1, 9.0, 1, 6.0, None)],
                               "trial_id long, t_s double, sample_id long, a double, event string")
    out = bl.baseline(df, "v4", ["a"], time_axis(), 5.0, marker="begin")
    assert by_id(out, "a_v4") == {0: 0.0, 1: 4.0}


def test_event_rules(spark):
    rows = [(7, float(i), i, g, e) for i, (g, e) in enumerate(
        [(1.0, "strain"), (2.0, None), (4.125, None), (3.75, None), (9.0, None), (3.0, None), (1.2, None), (1.2, None)])]
    df = spark.createDataFrame(rows, "trial_id long, t_s double, sample_id long, g double, event string")
    rules = spark.createDataFrame([(7, 4.1, True, True)], "trial_id long, g double, add_end boolean, clear_existing boolean")
    out = by_id(ev.apply_event_rules(df.withColumnRenamed("g", "level"), time_axis(block=2.0), rules, "level", "strain",
                                     "end", 1.2, 5000), "event")
    assert out == {0: None, 1: None, 2: "strain", 3: None, 4: None, 5: None, 6: "end", 7: None}


def test_fit_block_and_global_positions(spark):
    hot = spark.range(10_000).selectExpr("1 as trial_id", "id / 25.0 as t_s", "id as sample_id")
    block = fit_block(hot, "trial_id", "t_s", 10.0, rows=500)
    counts = hot.groupBy(F.floor(F.col("t_s") / block)).count().agg(F.max("count")).first()[0]
    assert counts <= 520
    ids = global_positions(spark.range(500).selectExpr("(id * 37) % 500 as k"), ["k"], "p")
    assert ids.where("k <> p").count() == 0


def test_blocks_are_partitioning_keys(spark, capsys):
    """Sample rows are shuffled by (trial, block), so a long trial is never one task."""
    df = spark.range(1000).selectExpr("id div 700 as trial_id", "cast(id as double) as t_s", "id as sample_id",
                                      "double(id) as v")
    running(df, time_axis(block=10.0), {"s": ("sum", F.col("v"))}).explain()
    shuffles = [x for x in capsys.readouterr().out.splitlines() if "hashpartitioning(" in x]
    by_trial = [x for x in shuffles if "trial_id" in x.split("hashpartitioning(")[1]]
    # rows meet by trial and block as one key; only the per-block totals meet by trial alone
    assert sum("__at" in x for x in shuffles if x not in by_trial) >= 1 and len(by_trial) <= 1
