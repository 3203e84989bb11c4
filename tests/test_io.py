"""Sources, sinks, caches, groups and streams."""

import pytest
from pyspark.sql import functions as F

from trialspan.plans import groups
from trialspan.sources import signals as src
from trialspan.sources import store
from trialspan.streaming import live


def test_side_files_and_bands(spark, tmp_path):
    for name, lines in {"rec_01_DC2_x.csv": "a\n5\n6\n", "rec_13_DC1_x.csv": "a\n7\n", "other.csv": "a\n9\n"}.items():
        (tmp_path / name).write_text(lines)
    df = src.read_side_files(spark, f"{tmp_path}/*.csv", "a double")
    assert sorted((r["trial_id"], r["row"], r["a"]) for r in df.collect()) == [
        ("01-02", 0, 5.0), ("01-02", 1, 6.0), ("13-01", 0, 7.0)]
    band = tmp_path / "b"
    band.mkdir()
    (band / "EEG_baseline_theta_1.csv").write_text("Fz,C3\n1.5,2\n3,4\n")
    (band / "EEG_baseline_delta_1.csv").write_text("Fz,C3\n10,20\n30,40\n")
    got = {(r["subject"], r["band"], r["channel"]): r["value"] for r in src.read_band_baseline(spark, f"{band}/*.csv").collect()}
    assert got[("02", "theta", "C3")] == 4 and got[("01", "delta", "Fz")] == 10 and len(got) == 8


def test_safe_names(spark):
    df, names = src.with_safe_names(spark.createDataFrame([(1, 2)], "`HR (bpm) - X.1` int, `HR [bpm] X 1` int"))
    assert df.columns == ["hr_bpm_x_1", "hr_bpm_x_1_2"] and names["hr_bpm_x_1"] == "HR (bpm) - X.1"
    with pytest.raises(ValueError):
        src.select_device(df, "nothing")


def test_cache_depends_on_every_parameter(spark, tmp_path):
    make = lambda n: lambda: spark.range(n).toDF("x")
    assert store.cached(spark, str(tmp_path), {"k": 1}, make(3)).count() == 3
    assert store.cached(spark, str(tmp_path), {"k": 1}, make(5)).count() == 3
    assert store.cached(spark, str(tmp_path), {"k": 2}, make(5)).count() == 5


def test_group_contract(spark):
    groups.register_group("t_bad", ["missing"], lambda df: df)
    groups.register_group("t_ok", ["z"], lambda df: df.withColumn("z", F.lit(1)))
    df = spark.range(1).toDF("id")
    assert groups.apply_groups(df, ["t_ok"]).columns == ["id", "z"] and groups.group_outputs(["t_ok", "t_ok"]) == ["z"]
    with pytest.raises(ValueError):
        groups.apply_groups(df, ["t_bad"])
    pupil = spark.createDataFrame([(3.0, 1.0)], "`Pupil diameter left [mm] - Tobii` double, `Pupil diameter right [mm] - Tobii` double")
    assert groups._GROUPS["eyetracking"].transform(pupil).first()["Pupil Difference [mm]"] == 2.0


def test_ffill_keeps_state_across_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([(1, 1, 5.0), (1, 2, None), (2, 1, None)], [(1, 3, None), (2, 2, 4.0)], [(2, 3, None), (1, 4, 6.0)]):
        spark.createDataFrame(rows, "k long, o long, v double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k long, o long, v double").option("maxFilesPerTrigger", 1).parquet(path)
    live.run_to_parquet(live.ffill_stream(stream, "k", ["o"], ["v"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["k"], r["o"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): 5.0, (1, 2): 5.0, (2, 1): 0.0, (1, 3): 5.0, (2, 2): 4.0, (2, 3): 4.0, (1, 4): 6.0}


def test_replay_keeps_one_device(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0, 2.0)], "ts long, `HR - Belt` double, `X - Eye` double").write.parquet(path)
    df = live.replay(spark, path, "ts long, `HR - Belt` double, `X - Eye` double", token="Belt")
    assert df.isStreaming and df.columns == ["ts", "HR - Belt"]


def test_demographics_and_rules(spark, tmp_path):
    from trialspan.sources import recording as rec

    head = ",".join(rec.DEMOGRAPHICS)
    lines = "\n".join(",".join(str(100 * i + j) for j in range(len(rec.DEMOGRAPHICS))) for i in range(3))
    (tmp_path / "d.csv").write_text(head + "\n" + lines + "\n")
    df = src.read_demographics(spark, str(tmp_path / "d.csv"))
    assert len(df.columns) == 55 and df.count() == 3
    r = {r["subject"]: r for r in df.collect()}["02"]
    at = list(rec.DEMOGRAPHICS.values()).index("participant_skinfolds_thigh_avg")
    assert r["participant_thigh_girth"] == r["participant_skinfolds_thigh_avg"] == 100 + at
    assert rec.event_rules(spark).count() == 15
