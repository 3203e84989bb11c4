"""Projections, filters, recodings and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import clean, quality

from .base import axis, check, matrix, signals, table

SIG = ["sig_a", "sig_b"]


def _ids(spark, sf):
    """Signals with a trial code in the ``SS-TT`` form."""
    return signals(spark, sf).withColumn("trial_code", F.format_string("%02d-%02d", "subject_id", "trial_id"))


@check("split_trial_id", "subject:s, trial:s, n:l", """
select substr(code, 1, 2) as subject, substr(code, 4) as trial, count(*) as n
from (select printf('%02d-%02d', subject_id, trial_id) as code from signals) group by 1, 2""")
def _(spark, sf):
    return clean.split_trial_id(_ids(spark, sf), "trial_code").groupBy("subject", "trial").agg(
        F.count(F.lit(1)).alias("n"))


@check("recode_condition", "cond:l, n:l", """
select case condition when 'N' then 0 when 'AFE' then 1 end as cond, count(*) as n
from (select case afe when 1 then 'AFE' else case when trial_id % 3 = 0 then 'other' else 'N' end end as condition
      from signals) group by 1""")
def _(spark, sf):
    df = signals(spark, sf).withColumn("condition", F.expr(
        "case afe when 1 then 'AFE' else case when trial_id % 3 = 0 then 'other' else 'N' end end"))
    return clean.recode(df, "condition", clean.CONDITION_CODES, "cond").groupBy("cond").agg(
        F.count(F.lit(1)).alias("n"))


@check("recode_response", "code:d, n:l", """
select case r when 'correct' then 1 when 'no response' then 0 when 'incorrect' then -1
   when 'NO VALUE' then null else try_cast(r as double) end as code, count(*) as n
from (select case event_type when 'error' then 'incorrect' when 'signup' then 'correct'
      when 'purchase' then 'no response' when 'view' then 'NO VALUE' else '2.5' end as r from events) group by 1""")
def _(spark, sf):
    df = table(spark, sf, "events").select(F.expr(
        "case event_type when 'error' then 'incorrect' when 'signup' then 'correct' "
        "when 'purchase' then 'no response' when 'view' then 'NO VALUE' else '2.5' end").alias("r"))
    return clean.recode(df, "r", clean.RESPONSE_CODES, "code", keep_other=True).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))


@check("diff_cols", "sample_id:l, diff:d", "select sample_id, sig_a - sig_b as diff from signals")
def _(spark, sf):
    return clean.diff_cols(signals(spark, sf), "sig_a", "sig_b", "diff")


@check("ratio_cols", "sample_id:l, ratio:d", """
select sample_id, case when sig_b <> 0 then sig_a / sig_b end as ratio from signals""")
def _(spark, sf):
    return clean.ratio_cols(signals(spark, sf), "sig_a", "sig_b", "ratio")


@check("fill_const", "sample_id:l, sig_a:d", "select sample_id, coalesce(sig_a, 1.2) as sig_a from signals")
def _(spark, sf):
    return clean.fill_const(signals(spark, sf), ["sig_a"])


@check("filter_scope", "kind:l, sample_id:l", """
select 0 as kind, sample_id from signals where subject_id = 3 and trial_id = 15
union all select 1, sample_id from signals where subject_id = 3
union all select 2, sample_id from signals""")
def _(spark, sf):
    df = signals(spark, sf)
    parts = [clean.filter_scope(df, k, 3, 15, "subject_id", "trial_id").select(F.lit(k).alias("kind"), "sample_id")
             for k in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("keep_groups", "want:l, sample_id:l", """
select 0 as want, sample_id from signals s where not exists
  (select 1 from signals t where t.trial_id = s.trial_id and t.afe = 1)
union all select 1, sample_id from signals s where exists
  (select 1 from signals t where t.trial_id = s.trial_id and t.afe = 1)""")
def _(spark, sf):
    df = signals(spark, sf)
    drop, keep = (clean.keep_groups(df, ["trial_id"], "afe", w).select(F.lit(w).alias("want"), "sample_id")
                  for w in (0, 1))
    return drop.unionByName(keep)


@check("drop_all_null_cols", "sample_id:l, sig_a:d, width:l", """
select sample_id, sig_a, 4 as width from signals""")
def _(spark, sf):
    df = signals(spark, sf).select("sample_id", "trial_id", "sig_a", "sig_b", F.lit(None).cast("double").alias("dead"))
    out = clean.drop_all_null_cols(df, ["sig_a", "sig_b", "dead"])
    return out.withColumn("width", F.lit(len(out.columns)))


@check("drop_null_rows", "sample_id:l, sig_a:d, sig_b:d", """
select sample_id, sig_a, sig_b from signals where sig_a is not null and sig_b is not null""")
def _(spark, sf):
    return clean.drop_null_rows(signals(spark, sf), SIG)


@check("constant_cols", "col:s, lo:d, hi:d, n_present:l, constant:b", """
select col, min(v) as lo, max(v) as hi, count(v) as n_present,
  coalesce(min(v) = max(v) and count(v) = count(*), false) as constant
from (select unnest([{'col': 'sig_a', 'v': sig_a}, {'col': 'sig_b', 'v': sig_b},
        {'col': 'one', 'v': cast(1 as double)}, {'col': 'holed', 'v': case when sig_a is not null then 1.0 end}],
        recursive := true) from signals) group by col""")
def _(spark, sf):
    df = signals(spark, sf).withColumns({"one": F.lit(1.0), "holed": F.when(F.col("sig_a").isNotNull(), 1.0)})
    return clean.column_ranges(df, ["sig_a", "sig_b", "one", "holed"]).withColumn(
        "constant", F.coalesce(F.expr("lo = hi and n_present = n"), F.lit(False)))


@check("drop_constant_cols", "sample_id:l, width:l", "select sample_id, 3 as width from signals")
def _(spark, sf):
    df = signals(spark, sf).select("sample_id", "sig_a", F.lit(2).alias("two"),
                                   F.when(F.col("sig_b").isNotNull(), 1).alias("holed"))
    out = clean.drop_constant_cols(df, ["sig_a", "two", "holed"])
    return out.withColumn("width", F.lit(len(out.columns)))


@check("ordinal_codes", "trial_id:l, code:l", """
select trial_id, row_number() over (order by t_s, sample_id) as code from
  (select trial_id, min(t_s) as t_s, arg_min(sample_id, (t_s, sample_id)) as sample_id from signals group by 1)""")
def _(spark, sf):
    return clean.ordinal_codes(signals(spark, sf), "trial_id", ["t_s", "sample_id"]).select(
        "trial_id", "code").distinct()


@check("finite_or_zero", "sample_id:l, v:d", """
select sample_id, case when sig_a is null or event = 'onset' then 0 else sig_a end as v from signals""")
def _(spark, sf):
    odd = F.expr("case when event = 'onset' then double('inf') else coalesce(sig_a, double('nan')) end")
    return signals(spark, sf).select("sample_id", clean.finite_or_zero(odd).alias("v"))


@check("distinct_values", "event:s", "select distinct event from signals")
def _(spark, sf):
    return clean.distinct_values(signals(spark, sf), "event")


@check("decide_threshold", "sample_id:l, prediction:l", """
select sample_id, cast(sig_b >= 30 as int) as prediction from signals""")
def _(spark, sf):
    return clean.decide(signals(spark, sf), "sig_b", 30)


@check("null_profile", "trial_id:l, feature:s, n:l, n_null:l, null_share:d", """
select trial_id, 'sig_a' as feature, count(*) as n, count(*) - count(sig_a) as n_null,
  (count(*) - count(sig_a)) / count(*) as null_share from signals group by 1
union all select trial_id, 'sig_b', count(*), count(*) - count(sig_b), (count(*) - count(sig_b)) / count(*)
  from signals group by 1""")
def _(spark, sf):
    return quality.null_profile(signals(spark, sf), ["trial_id"], SIG)


NULL_EVENT = """
select trial_id, sum(y) as n_event,
  sum(case when y = 1 and (sig_a is null or sig_b is null) then 1 else 0 end) as n_event_null,
  case when sum(y) > 0 then sum(case when y = 1 and (sig_a is null or sig_b is null) then 1 else 0 end) / sum(y)
    end as event_null_share,
  case when count(sig_a) = 0 or count(sig_b) = 0 then 1 else 0 end as any_all_null,
  case when sum(y) > 0 then case when count(case when y = 1 then sig_a end) = 0
     or count(case when y = 1 then sig_b end) = 0 then 1 else 0 end end as event_all_null
from labelled group by 1"""


def labelled(spark, sf):
    from trialspan.operators.events import label_intervals

    return label_intervals(signals(spark, sf), axis(spark, sf), "onset", "recovery", out="y")


@check("null_during_event", "trial_id:l, n_event:l, n_event_null:l, event_null_share:d, any_all_null:l, "
       "event_all_null:l", NULL_EVENT)
def _(spark, sf):
    return quality.null_during_event(labelled(spark, sf), ["trial_id"], SIG, "y")


@check("incomplete_summary", "n_trials:l, n_all_null:l, n_with_event:l, n_event_all_null:l", f"""
select count(*) as n_trials, sum(any_all_null) as n_all_null, count(event_all_null) as n_with_event,
  coalesce(sum(event_all_null), 0) as n_event_all_null from ({NULL_EVENT})""")
def _(spark, sf):
    return quality.incomplete_summary(quality.null_during_event(labelled(spark, sf), ["trial_id"], SIG, "y"))


@check("drop_incomplete_groups", "sample_id:l", """
select sample_id from signals where trial_id not in (
  select trial_id from signals group by 1 having count(sig_a) = 0 or count(sig_b) = 0)""")
def _(spark, sf):
    return quality.drop_incomplete_groups(signals(spark, sf), ["trial_id"], SIG)


@check("fill_from_condition", "sample_id:l, sig_a:d, sig_b:d", """
select sample_id,
  case when afe = 0 and sig_a is null then (select avg(sig_a) from signals where afe = 1) else sig_a end as sig_a,
  case when afe = 1 and sig_b is null then (select avg(sig_b) from signals where afe = 0) else sig_b end as sig_b
from signals""")
def _(spark, sf):
    return quality.fill_from_condition(signals(spark, sf), "afe", {1: ["sig_a"], 0: ["sig_b"]})


LATENCY = """
select trial_id, t_onset, t_level, t_onset - t_level as latency from (
  select trial_id, min(case when event = 'onset' and t_s >= start then t_s end) as t_onset,
    min(case when sig_b >= 13 and t_s >= start then t_s end) as t_level
  from (select *, case when trial_id % 5 = 0 then 600000 else 400000 end as start from signals) group by 1)
where t_onset is not null and t_level is not null"""


def _latency(spark, sf):
    df = signals(spark, sf)
    late = df.where("trial_id % 5 = 0").select("trial_id", F.lit(600000.0).alias("start")).distinct()
    return quality.onset_latency(df, "trial_id", "t_s", "event", "onset", "sig_b", 13, 400000, late)


@check("onset_latency", "trial_id:l, t_onset:l, t_level:l, latency:l", LATENCY)
def _(spark, sf):
    return _latency(spark, sf)


@check("latency_summary", "mean:d, median:d, max:d, min:d, range:d, std:d3", f"""
select avg(latency) as mean, median(latency) as median, max(latency) as max, min(latency) as min,
  max(latency) - min(latency) as range, stddev_pop(latency) as std from ({LATENCY})""")
def _(spark, sf):
    return quality.latency_summary(_latency(spark, sf))


@check("describe", "feature:s, n:l, n_null:l, mean:d, std:d, min:d, q25:d, q50:d, q75:d, max:d", """
select feature, count(v) as n, count(*) - count(v) as n_null, avg(v) as mean, stddev_samp(v) as std, min(v) as min,
  quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.75) as q75, max(v) as max
from (select 'sig_a' as feature, sig_a as v from signals union all select 'sig_b', sig_b from signals) group by 1""")
def _(spark, sf):
    return quality.describe(signals(spark, sf), SIG)


@check("label_distribution", "y:l, n:l, percent:d, event_rate:d", """
select y, count(*) as n, round(100.0 * count(*) / (select count(*) from labelled), 2) as percent,
  (select avg(y) from labelled) as event_rate from labelled group by 1""")
def _(spark, sf):
    return quality.label_distribution(labelled(spark, sf), "y")


@check("compare_shapes", "dataset:s, n_rows:l, n_features:l", """
select 'raw' as dataset, count(*) as n_rows, 8 as n_features from signals
union all select 'engineered', count(*), 66 from embeddings""")
def _(spark, sf):
    return quality.compare_shapes(signals(spark, sf), matrix(spark, sf), keys=["vec_id", "grp"])
