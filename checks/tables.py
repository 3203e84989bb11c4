"""Feature catalog, metrics, fold summaries and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import catalog as cat
from trialspan.operators import metrics as mt

from .base import CTES, check, feature_catalog, predictions, table

CTES["base_names"] = "select distinct regexp_replace(feature, '_(mean|stddev|max|range)_s[12]$', '') as feature from catalog"
CTES["selected"] = "select distinct p_size % 3 as model, p_brand || '/' || p_type as feature from part"
CTES["folds"] = """
select model, fold, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) as accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(tn / nullif(tn + fp, 0), 0) as specificity,
  sqrt(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0)) as g_mean
from (select model, fold, count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp,
   count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 0 and p = 0) as tn
  from preds group by 1, 2)"""
CTES["combos"] = """
select s_nationkey as grp, list_sort(list_distinct(list(case s_suppkey % 6 when 0 then 'ECG' when 1 then 'HR'
  when 2 then 'BR' when 3 then 'Temperature' when 4 then 'Participant' else 'Centrifuge' end))) as components
from supplier group by 1"""
STATS = ["accuracy", "precision", "recall", "f1", "specificity", "g_mean"]
FOLD_SPEC = "tp:l, fp:l, fn:l, tn:l, " + ", ".join(f"{m}:d" for m in STATS)


def base_names(spark, sf):
    return feature_catalog(spark, sf).select(
        F.regexp_replace("feature", "_(mean|stddev|max|range)_s[12]$", "").alias("feature")).distinct()


def selected(spark, sf):
    return table(spark, sf, "part").selectExpr("p_size % 3 as model", "concat(p_brand, '/', p_type) as feature").distinct()


def folds(spark, sf):
    return mt.binary_metrics(predictions(spark, sf), keys=["model", "fold"])


def combos(spark, sf):
    name = F.expr("case s_suppkey % 6 when 0 then 'ECG' when 1 then 'HR' when 2 then 'BR' when 3 then 'Temperature' "
                  "when 4 then 'Participant' else 'Centrifuge' end")
    return table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("grp")).agg(
        F.array_sort(F.collect_set(name)).alias("components"))


@check("feature_groups", "feature:s, grp:s", """
select feature, grp from (select feature, case when contains(feature, 'EEG') then 'rawEEG'
   when contains(feature, 'Pupil') then 'eyetracking' when contains(feature, 'Centrifuge') then 'G' else 'ECG' end as grp,
   case substr(feature, 7, 1) when '1' then 'AFE' when '2' then 'noAFE' else 'shared' end as owner from catalog)
where grp in ('ECG', 'eyetracking', 'rawEEG') and owner in ('shared', 'noAFE')""")
def _(spark, sf):
    c = feature_catalog(spark, sf).selectExpr(
        "feature", "case when contains(feature, 'EEG') then 'rawEEG' when contains(feature, 'Pupil') then 'eyetracking' "
        "when contains(feature, 'Centrifuge') then 'G' else 'ECG' end as grp",
        "case substr(feature, 7, 1) when '1' then 'AFE' when '2' then 'noAFE' else 'shared' end as owner")
    return cat.features_for(c, "noAFE", "Implicit")


@check("select_streams", "feature:s", r"""
select feature from catalog where regexp_matches(feature, '\bhr\b', 'i') or regexp_matches(feature, 'participant_hr', 'i')
  or regexp_matches(feature, 'pupil', 'i') or regexp_matches(feature, 'centrifuge', 'i')""")
def _(spark, sf):
    return cat.select_streams(feature_catalog(spark, sf), ["HR", "Pupil", "gforce", "HR"])


@check("select_streams_substring", "feature:s, matches:l", """
select feature, cast(contains(lower(feature), 'hr') as int) + cast(contains(lower(feature), 'eeg') as int)
  + cast(contains(lower(feature), 'max') as int) as matches from catalog
where contains(lower(feature), 'hr') or contains(lower(feature), 'eeg') or contains(lower(feature), 'max')""")
def _(spark, sf):
    return cat.select_streams_substring(feature_catalog(spark, sf), ["HR", "EEG", "max"])


@check("keep_unengineered", "feature:s", """
select feature from base_names where regexp_replace(feature, '_v[0-8]$', '') in (
  select regexp_replace(feature, '_v[0-8](_2?derivative)?$', '') from base_names where feature not like '%Pupil%')""")
def _(spark, sf):
    names = base_names(spark, sf)
    streams = names.where("feature not like '%Pupil%'").select(
        F.regexp_replace("feature", "_v[0-8](_2?derivative)?$", "").alias("stream"))
    return cat.keep_unengineered(names, streams)


PREFER = " union all ".join(f"""
select {m} as method, feature from (select feature, row_number() over (partition by stem order by list_position([{
    ', '.join(repr(v) for v in vs)}], v)) as k from (select feature,
    regexp_extract(feature, '^(.*)_(v[0-8])$', 1) as stem, regexp_extract(feature, '^(.*)_(v[0-8])$', 2) as v
    from base_names) where v in ({', '.join(repr(v) for v in vs)})) where k = 1"""
                            for m, vs in cat.BASELINE_PREFERENCE.items())


@check("prefer_baseline", "method:l, feature:s", PREFER + " union all select 5, feature from base_names")
def _(spark, sf):
    names, out = base_names(spark, sf), None
    for m in range(6):
        one = cat.prefer_baseline(names, m).select(F.lit(m).alias("method"), "feature")
        out = one if out is None else out.unionByName(one)
    return out


PARSED = """
select feature, nullif(regexp_extract(feature, '_(v[0-8])(_|$)', 1), '') as baseline,
  case when contains(feature, '_2derivative') then 2 when contains(feature, '_derivative') then 1 else 0 end as derivative,
  nullif(regexp_extract(feature, '_(mean|stddev|max|range|additional)(_|$)', 1), '') as statistic,
  nullif(regexp_extract(feature, '_(s1|s2)$', 1), '') as standardization from catalog"""


@check("parse_feature", "feature:s, baseline:s, derivative:l, statistic:s, standardization:s", PARSED)
def _(spark, sf):
    return cat.parse_feature(feature_catalog(spark, sf))


@check("feature_census", "kind:s, value:s, n:l", f"""
with p as ({PARSED})
select 'baseline' as kind, baseline as value, count(*) as n from p where baseline is not null group by 2
union all select 'statistic', statistic, count(*) from p where statistic is not null group by 2
union all select 'standardization', standardization, count(*) from p where standardization is not null group by 2""")
def _(spark, sf):
    return cat.feature_census(cat.parse_feature(feature_catalog(spark, sf)))


@check("restrict_to_saved", "feature:s", """
select feature from catalog where feature in (select feature from catalog where feature like '%_v5%')""")
def _(spark, sf):
    c = feature_catalog(spark, sf)
    return cat.restrict_catalog(c, c.where("feature like '%_v5%'"))


RAW = "select r_regionkey as ord, case r_regionkey when 0 then 'EEG' when 1 then 'Brand#1' when 2 then 'Pupil' when 3 then 'Brand#2' else 'SMALL' end as raw from region"


@check("map_raw_to_features", "feature:s, raw:s", f"""
select feature, (select arg_min(r.raw, r.ord) from ({RAW}) r where contains(c.feature, r.raw)) as raw from catalog c""")
def _(spark, sf):
    return _mapped(spark, sf)


def _mapped(spark, sf):
    raw = table(spark, sf, "region").selectExpr(*[
        "r_regionkey as ord", "case r_regionkey when 0 then 'EEG' when 1 then 'Brand#1' when 2 then 'Pupil' "
        "when 3 then 'Brand#2' else 'SMALL' end as raw"])
    return cat.map_raw_to_features(feature_catalog(spark, sf), raw)


@check("unmatched_features", "feature:s", f"""
select feature from catalog c where not exists (select 1 from ({RAW}) r where contains(c.feature, r.raw))""")
def _(spark, sf):
    return cat.unmatched_features(_mapped(spark, sf))


ALIASED = """
select grp, list_sort(list_concat(
  list_filter(components, lambda x: not (x in ('ECG', 'HR', 'BR', 'Temperature') and list_has_all(components,
     ['ECG', 'HR', 'BR', 'Temperature'])) and x not in ('Participant', 'Centrifuge')),
  case when list_has_all(components, ['ECG', 'HR', 'BR', 'Temperature']) then ['Equivital'] else [] end,
  case when list_contains(components, 'Participant') then ['Demographics'] else [] end,
  case when list_contains(components, 'Centrifuge') then ['G Force'] else [] end)) as components from combos"""


@check("alias_groups", "grp:l, names:s", f"select grp, array_to_string(components, '+') as names from ({ALIASED})")
def _(spark, sf):
    return cat.alias_groups(combos(spark, sf)).withColumn("names", F.array_join("components", "+"))


@check("component_matrix", "component:s, g0:l, g1:l, g2:l, g3:l", """
select component, max(case when grp % 4 = 0 then 1 else 0 end) as g0, max(case when grp % 4 = 1 then 1 else 0 end) as g1,
  max(case when grp % 4 = 2 then 1 else 0 end) as g2, max(case when grp % 4 = 3 then 1 else 0 end) as g3
from (select grp, unnest(components) as component from combos) group by 1""")
def _(spark, sf):
    g = combos(spark, sf).withColumn("grp", F.concat(F.lit("g"), F.col("grp") % 4))
    return cat.component_matrix(g, names=["g0", "g1", "g2", "g3"])


@check("filter_groups", "grp:l", """
select grp from combos where components in (select components from combos where grp % 6 = 1)""")
def _(spark, sf):
    g = combos(spark, sf)
    return cat.filter_groups(g, g.where("grp % 6 = 1"))


@check("shared_features", "feature:s", """
select feature from selected group by 1 having count(*) = (select count(distinct model) from selected)""")
def _(spark, sf):
    return cat.shared_features(selected(spark, sf))


@check("unshared_features", "model:l, feature:s", """
select model, feature from selected where feature not in (
  select feature from selected group by 1 having count(*) = (select count(distinct model) from selected))""")
def _(spark, sf):
    return cat.unshared_features(selected(spark, sf))


@check("membership_counts", "members:s, n:l", """
select members, count(*) as n from (select feature, string_agg(cast(model as varchar), '+' order by model) as members
  from selected group by 1) group by 1""")
def _(spark, sf):
    return cat.membership_counts(selected(spark, sf))


@check("confusion", "truth:l, pred_0:l, pred_1:l", """
select y as truth, count(*) filter (where p = 0) as pred_0, count(*) filter (where p = 1) as pred_1 from preds group by 1""")
def _(spark, sf):
    return mt.confusion(predictions(spark, sf))


@check("binary_metrics", "model:l, fold:l, " + FOLD_SPEC, "select * from folds")
def _(spark, sf):
    return folds(spark, sf)


@check("roc_curve", "score:d9, tp:l, fp:l, tpr:d, fpr:d", """
select score, sum(a) over w as tp, sum(b) over w as fp, sum(a) over w / (select sum(y) from preds) as tpr,
  sum(b) over w / (select count(*) - sum(y) from preds) as fpr
from (select score, sum(y) as a, count(*) - sum(y) as b from preds group by 1) window w as (order by score desc)""")
def _(spark, sf):
    return mt.roc_curve(predictions(spark, sf))


@check("roc_auc", "auc:d9", """
select (select sum(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end)
   from preds a join preds b on a.y = 1 and b.y = 0)
  / ((select count(*) from preds where y = 1) * (select count(*) from preds where y = 0)) as auc""")
def _(spark, sf):
    return mt.roc_auc(predictions(spark, sf))


@check("summarize_folds", "metric:s, n_folds:l, mean:d, std:d", """
select metric, count(*) as n_folds, avg(v) as mean, stddev_pop(v) as std from (
  unpivot folds on accuracy, precision, recall, f1, specificity, g_mean into name metric value v) group by 1""")
def _(spark, sf):
    return mt.summarize_folds(folds(spark, sf))


@check("median_fold", "model:l, f1_median:d, fold:l, recall:d", """
with r as (select *, row_number() over (partition by model order by f1, fold) as k, count(*) over (partition by model) as n
  from folds), m as (select model, f1 as f1_median from r where k = n // 2 + 1)
select m.model, f1_median, min(fold) as fold, arg_min(recall, fold) as recall
from m join folds f on f.model = m.model and f.f1 = f1_median group by 1, 2""")
def _(spark, sf):
    return mt.median_fold(folds(spark, sf), ["recall"], ["model"])


@check("threshold_choice", "model:l, fold:l, threshold:d, f1:d", """
with t as (select unnest(range(100, 901)) as k),
c as (select model, fold, k, count_if(y = 1 and score * 1000 >= k) as tp, count_if(y <> 1 and score * 1000 >= k) as fp, count_if(y = 1) as pos
  from preds, t group by 1, 2, 3),
f as (select *, case when tp + fp + pos > 0 then 2.0 * tp / (tp + fp + pos) else 0 end as f1 from c),
b as (select *, row_number() over (partition by model, fold order by f1 desc, k) as r from f)
select model, fold, k / 1000.0 as threshold, f1 from b where r = 1""")
def _(spark, sf):
    """The threshold with the best F1, from binned scores, against every threshold over all scores."""
    p = predictions(spark, sf)
    return mt.best_threshold(mt.threshold_curve(p, ["model", "fold"], "score", "y"), ["model", "fold"])


@check("f1_ci", "model:l, median:d, n:l, std:d, ci95:d, is_best:b", """
select *, model = (select arg_max(model, (median, model)) from (select model, median(f1) as median from folds group by 1))
  as is_best from (select model, median(f1) as median, count(f1) as n, stddev_samp(f1) as std,
  1.96 * stddev_samp(f1) / sqrt(count(f1)) as ci95 from folds group by 1)""")
def _(spark, sf):
    return mt.f1_ci(folds(spark, sf))


@check("balanced_summary", "model:l, f1_mean:d, f1_ci:d, balanced_accuracy:d, balanced_ci:d", """
select model, avg(f1) as f1_mean, 1.96 * stddev_samp(f1) / sqrt(count(*)) as f1_ci,
  (avg(recall) + avg(specificity)) / 2 as balanced_accuracy,
  1.96 * stddev_samp(recall) / sqrt(count(*)) + 1.96 * stddev_samp(specificity) / sqrt(count(*)) as balanced_ci
from folds group by 1""")
def _(spark, sf):
    return mt.balanced_summary(folds(spark, sf))


@check("metric_curve", "band:s, fold:l, seconds:d, mean:d, low:d, high:d", """
select 'std' as band, fold, fold / 25 as seconds, avg(f1) as mean, avg(f1) - stddev_samp(f1) as low,
  avg(f1) + stddev_samp(f1) as high from folds group by 2
union all select 'sem', fold, fold / 25, avg(f1), avg(f1) - stddev_samp(f1) / sqrt(count(*)),
  avg(f1) + stddev_samp(f1) / sqrt(count(*)) from folds group by 2
union all select 'minmax', fold, fold / 25, avg(f1), min(f1), max(f1) from folds group by 2""")
def _(spark, sf):
    f = folds(spark, sf)
    a, b, c = (mt.metric_curve(f, "fold", "f1", k, 25).withColumn("band", F.lit(k)) for k in ("std", "sem", "minmax"))
    return a.unionByName(b).unionByName(c)


@check("metrics_table", "metric:s, m0:d, m1:d, m2:d", """
select metric, avg(v) filter (where model = 0) as m0, avg(v) filter (where model = 1) as m1,
  avg(v) filter (where model = 2) as m2 from (
  unpivot folds on accuracy, precision, recall, f1, specificity, g_mean into name metric value v) group by 1""")
def _(spark, sf):
    return mt.metrics_table(folds(spark, sf).withColumn("model", F.concat(F.lit("m"), "model")))


@check("union_runs", "run:s, model:l, fold:l, f1:d", """
select 'first' as run, model, fold, f1 from folds where fold < 5
union all select 'second', model, fold, f1 from folds where fold >= 5""")
def _(spark, sf):
    f = folds(spark, sf)
    return mt.union_runs({"first": f.where("fold < 5"), "second": f.where("fold >= 5")})


@check("histogram", "model:l, bin:l, edge:d, n:l", """
with s as (select min(score) as lo, max(score) as hi from preds)
select model, least(floor((score - lo) * 15 / (hi - lo)), 14) as bin, any_value(lo + least(floor((score - lo) * 15
  / (hi - lo)), 14) * (hi - lo) / 15) as edge, count(*) as n from preds, s group by 1, 2""")
def _(spark, sf):
    return mt.histogram(predictions(spark, sf), "score", 15, ["model"])


@check("class_weights", "y:l, n:l, weight:d", """
select y, count(*) as n, (select count(*) from preds) / (2.0 * count(*)) as weight from preds group by 1""")
def _(spark, sf):
    return mt.class_weights(predictions(spark, sf))


@check("metrics_by_subject", "subject:l, model:l, f1:d, g_mean:d", """
select subject, model, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1,
  sqrt(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0)) as g_mean from (
 select doc_id % 13 as subject, model, count(*) filter (where y = 1 and p = 1) as tp,
   count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn,
   count(*) filter (where y = 0 and p = 0) as tn from preds group by 1, 2)""")
def _(spark, sf):
    return mt.metrics_by_subject(predictions(spark, sf).withColumn("subject", F.expr("doc_id % 13")), "subject")


@check("running_best", "model:l, fold:l, best:d", """
select model, fold, max(f1) over (partition by model order by fold) as best from folds""")
def _(spark, sf):
    return mt.running_best(folds(spark, sf), ["model"], "fold")


@check("top_features", "feature:s, total:d3", """
select p_brand || '/' || p_type as feature, sum(abs(p_retailprice - 1000)) as total from part group by 1
order by total desc, feature limit 20""")
def _(spark, sf):
    long = table(spark, sf, "part").selectExpr("concat(p_brand, '/', p_type) as feature", "p_retailprice - 1000 as shap")
    return mt.top_features(long, 20)


@check("results_long", "model:l, fold:l, f1:d", """
select model, row_number() over (partition by model order by fold) - 1 as fold, f1 from folds""")
def _(spark, sf):
    nested = folds(spark, sf).groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "f1"))),
                                                               lambda r: r["f1"]).alias("f1"))
    return mt.results_long(nested, ["model"])


@check("ablation_review", "grp:l, median:d, mean:d, n:l", """
select model as grp, median(f1) as median, avg(f1) as mean, count(f1) as n from folds group by 1""")
def _(spark, sf):
    return mt.ablation_review(folds(spark, sf).withColumnRenamed("model", "grp"))
