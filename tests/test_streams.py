"""Event-time operators on streams against loops in Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspan.streaming import live

SCHEMA = "trial long, n long, ts timestamp, `x.1` double"


def record(spark, path, parts):
    for rows in parts:
        df = spark.createDataFrame(rows, "trial long, n long, t double, `x.1` double")
        df.select("trial", "n", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "`x.1`").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def drain(spark, df, tmp_path):
    live.run_to_parquet(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.fixture
def samples():
    rng = random.Random(1)
    return [(rng.choice([1, 1, 1, 2, None]), i, 1000.0 + i / 3, None if rng.random() < .3 else 1e8 + rng.gauss(0, 1e-3)) for i in range(400)]


def test_windows_of_a_closed_recording(spark, tmp_path, samples):
    """All windows come out, also the last ones, of a null trial too; a large offset keeps its deviation."""
    path = str(tmp_path / "in")
    record(spark, path, [samples[:150], samples[150:]])
    live.close_recording(spark, path, SCHEMA, "ts", "1 hour")
    stream = live.replay(spark, path, SCHEMA, "ts")
    got = drain(spark, live.sliding_stats_stream(stream, "trial", "ts", ["x.1"], "20 seconds", "5 seconds", "10 seconds"), tmp_path).collect()
    want = {}
    for trial, _, t, x in samples:
        last = int(t // 5) * 5
        for b in range(last - 15, last + 1, 5):
            want.setdefault((trial, b), []).append(x)
    assert {(r.trial, int(r.t_begin.timestamp())) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        x = [v for v in want[r.trial, int(r.t_begin.timestamp())] if v is not None]
        if not x:
            assert r["x.1_mean"] is None and r["x.1_stddev"] is None
        else:
            assert r["x.1_mean"] == pytest.approx(np.mean(x), abs=1e-6) and r["x.1_max"] == max(x)
            assert r["x.1_stddev"] == pytest.approx(np.std(x), rel=1e-4, abs=1e-9)


def filled(rows):
    out, last = {}, {}
    for trial, n, _, x in sorted(rows, key=lambda r: (r[2], r[1])):
        last[trial] = x if x is not None else last.get(trial)
        out[n] = 0.0 if last[trial] is None else last[trial]
    return out


def test_fill_in_event_time_order(spark, tmp_path, samples):
    path, rng = str(tmp_path / "in"), random.Random(2)
    rows = samples[:]
    rng.shuffle(rows)
    record(spark, path, [rows[i::4] for i in range(4)])
    live.close_recording(spark, path, SCHEMA, "ts", "1 hour")
    out = live.ffill_events(live.replay(spark, path, SCHEMA, "ts"), "trial", "ts", ["x.1"], "200 seconds", ["n"], slice_seconds=7.0)
    got = drain(spark, out, tmp_path)
    assert got.columns == ["trial", "ts", "n", "x.1"]
    assert {r.n: r["x.1"] for r in got.collect()} == filled(samples)


def test_quiet_trials_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, 0, 100.0, 5.0), (1, 1, 101.0, None), (2, 2, 130.0, 1.0), (2, 3, 180.0, 2.0), (1, 4, 300.0, None)]
    record(spark, path, [rows[:2], rows[2:3], rows[3:4], [(2, 5, 290.0, 3.0)], rows[4:]])
    live.close_recording(spark, path, SCHEMA, "ts", "1 hour")
    out = live.ffill_events(live.replay(spark, path, SCHEMA, "ts"), "trial", "ts", ["x.1"], "1 second", ["n"], leftover=-1.0, slice_seconds=10.0, idle_seconds=50.0)
    got = {r.n: r["x.1"] for r in drain(spark, out, tmp_path).collect()}
    assert got == {0: 5.0, 1: 5.0, 2: 1.0, 3: 2.0, 5: 3.0, 4: -1.0}


def test_merged_moments(spark):
    rng = np.random.default_rng(4)
    parts = [1e9 + rng.normal(0, 1e-2, n) for n in (1, 5, 40)]
    rows = [(len(p), float(p.mean()), float(((p - p.mean()) ** 2).sum())) for p in parts] + [(0, None, None)]
    df = spark.createDataFrame(rows, "n long, mean double, m2 double")
    m = df.agg(live.merged(F.collect_list(F.struct("n", "mean", "m2"))).alias("m")).first()["m"]
    every = np.concatenate(parts)
    assert m["n"] == 46 and m["mean"] == pytest.approx(every.mean()) and m["m2"] / 46 == pytest.approx(every.var(), rel=1e-4)


def test_trials_of_a_bucket_keep_apart(spark, tmp_path, samples):
    """All trials in one bucket, in arrival and in event-time order; a trial that pauses gets its own last value."""
    rows = samples + [(1 << 60, 400, 2000.0, None), (2, 401, 2001.0, None), (None, 402, 2002.0, None), ((1 << 60) + 1, 403, 2003.0, 7.0)]
    path = str(tmp_path / "in")
    record(spark, path, [rows[:100], rows[100:300], rows[300:]])
    stream = live.replay(spark, path, SCHEMA, "ts", bytes_per_trigger=1)
    got = drain(spark, live.ffill_stream(stream.withColumnRenamed("x.1", "x"), "trial", ["ts", "n"], ["x"], buckets=1), tmp_path)
    assert {(r.trial, r.n): r.x for r in got.collect()} == {(t, n): filled(rows)[n] for t, n, _, _ in rows}
    live.close_recording(spark, path, SCHEMA, "ts", "1 hour")
    out = live.ffill_events(live.replay(spark, path, SCHEMA, "ts"), "trial", "ts", ["x.1"], "2000 seconds", ["n"], slice_seconds=30.0, buckets=1)
    live.run_to_parquet(out, str(tmp_path / "out2"), str(tmp_path / "cp2"))
    again = spark.read.parquet(str(tmp_path / "out2")).collect()
    assert {(r.trial, r.n): r["x.1"] for r in again} == {(t, n): filled(rows)[n] for t, n, _, _ in rows}


def test_micro_batches_follow_bytes(spark, tmp_path, samples):
    path = str(tmp_path / "in")
    record(spark, path, [samples[i::20] for i in range(20)])
    live.close_recording(spark, path, SCHEMA, "ts", "1 hour")
    stream = live.replay(spark, path, SCHEMA, "ts", bytes_per_trigger=1 << 20)
    assert drain(spark, live.sliding_stats_stream(stream, "trial", "ts", ["x.1"], "20 seconds", "5 seconds", "10 seconds"), tmp_path).count() > 0
    assert len(list((tmp_path / "cp" / "commits").glob("[0-9]*"))) <= 3
