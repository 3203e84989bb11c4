"""Feature selection, models, experiments, attribution, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trialspan.operators import attribution as at
from trialspan.operators import metrics as mt
from trialspan.functions.sizing import attach_one, cut
from trialspan.functions.timeline import positions, sorted_axis
from trialspan.operators import sampling
from trialspan.operators import selection as sel
from trialspan.operators import sequences
from trialspan.operators import windows as win
from trialspan.plans import experiments as ex
from trialspan.plans import groups, models
from trialspan.session import shared_dir
from trialspan.sources import signals as src
from trialspan.sources import store
from trialspan.streaming import live

from .base import MATRIX, OFFSET, STRIDE, WINDOW, axis, check, feature_catalog, matrix, predictions, signals, table
from .timelines import SLIDE, labelled

SCORE = "tp:l, fp:l, fn:l, tn:l, accuracy:d, precision:d, recall:d, f1:d, specificity:d, g_mean:d"


def scratch(spark, name):
    """A new folder under the shared directory."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def split(spark, sf):
    m = matrix(spark, sf)
    return m.where("vec_id % 4 <> 0"), m.where("vec_id % 4 = 0")


def names_frame(spark, sf, names):
    """Every column with its label correlation over the whole table and whether it was kept."""
    m = matrix(spark, sf)
    return m.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.corr(c, F.col("y").cast("double")).alias("corr"),
                                    F.lit(c in names).alias("kept")) for c in MATRIX]).alias("s")).select(F.inline("s"))


# --- selection ------------------------------------------------------------------------------

@check("select_lasso", "feature:s, corr:d4, kept:b")
def _(spark, sf):
    return names_frame(spark, sf, sel.select_lasso(matrix(spark, sf), "vec_id", MATRIX, "y"))


@check("select_enet", "feature:s, corr:d4, kept:b")
def _(spark, sf):
    return names_frame(spark, sf, sel.select_enet(matrix(spark, sf), "vec_id", MATRIX, "y"))


@check("select_ridge", "feature:s, corr:d4, kept:b")
def _(spark, sf):
    return names_frame(spark, sf, sel.select_ridge(matrix(spark, sf), "vec_id", MATRIX, "y", 20))


def optimal(ratio):
    """Whether the coefficients that the search chose meet their conditions, measured on all rows."""
    def run(spark, sf):
        m = matrix(spark, sf)
        folds = sel.fold_moments(m, "vec_id", MATRIX, "y", k=10)
        b, alpha, r = sel.search_linear(folds, sel.ALPHAS, [ratio])
        return sel.optimality(m, MATRIX, "y", b, alpha, r).select("feature", (F.col("excess") < 1e-7).alias("optimal"))
    return run


# 50 penalties on 10 folds from one pass
OPTIMAL = "select 'x' || i as feature, true as optimal from (select unnest(range(1, 65)) as i)"
check("lasso_optimal", "feature:s, optimal:b", OPTIMAL)(optimal(1.0))
check("enet_optimal", "feature:s, optimal:b", OPTIMAL)(optimal(0.5))
check("ridge_optimal", "feature:s, optimal:b", OPTIMAL)(optimal(0.0))


@check("fold_moments", "fold:l, n:l, feature:s, mean:d, with_y:d", """
with r as (select vec_id, y, (row_number() over (partition by y order by md5(concat('42:', cast(vec_id as varchar))), vec_id) - 1) % 3 as fold from rows),
f as (select fold, count(*) as n from r group by 1)
select fold, n, 'x' || dim as feature, avg(x) as mean, covar_pop(x, r.y) as with_y
from r join f using (fold) join cells using (vec_id) group by 1, 2, dim""")
def _(spark, sf):
    folds = sel.fold_moments(matrix(spark, sf), "vec_id", MATRIX, "y")
    rows = [(k, m.n, c, float(m.mean[i]), float(m.scatter[i, -1] / m.n)) for k, m in enumerate(folds) for i, c in enumerate(MATRIX)]
    return spark.createDataFrame(rows, "fold long, n long, feature string, mean double, with_y double")


@check("pca_shares", "component:l, share_ok:b, apart:b", "select unnest(range(64)) as component, true as share_ok, true as apart")
def _(spark, sf):
    """Each component's share against the variance of the projected rows, and that it is uncorrelated with the next one."""
    m = matrix(spark, sf)
    values, _ = sel.components(sel.moments_by(m, MATRIX)[0])
    (made,), k = sel.reduce_pca(m, MATRIX, 1.0)
    whole = sum((F.var_samp(c) for c in MATRIX), F.lit(0.0))
    pc = [F.get("pca", F.lit(i)) for i in range(k)]
    row = made.agg(F.array(*[F.struct(F.var_samp(p).alias("v"), F.corr(p, pc[(i + 1) % k]).alias("c"), F.lit(float(values[i] / values.sum())).alias("share"))
                             for i, p in enumerate(pc)]).alias("s"), whole.alias("all"))
    each = row.select("all", F.posexplode("s").alias("component", "x"))
    return each.select("component", (F.abs(F.col("x.v") / F.col("all") - F.col("x.share")) < 1e-9).alias("share_ok"),
                       (F.abs(F.col("x.c")) < 1e-6).alias("apart"))


@check("pca_tuned", "share:d, components:l, likelihood:d4, best:b")
def _(spark, sf):
    """Held-out likelihood of every share, and the one chosen."""
    m = matrix(spark, sf)
    chosen, k = sel.tune_share(m, "vec_id", MATRIX)
    folds = list(sel.moments_by(sel.stratified_folds(m.withColumn("one", F.lit(0)), "vec_id", "one", 3), MATRIX, "fold").values())
    total = sel.together(folds, 64)
    rows = []
    for share in sel.SHARES:
        marks = [sel.component_likelihood(total - f, f, sel.components_for(sel.components(total - f)[0], share)) for f in folds]
        rows.append((share, sel.components_for(sel.components(total)[0], share), sum(marks) / len(marks), share == chosen))
    return spark.createDataFrame(rows, "share double, components long, likelihood double, best boolean")


@check("reduce_pca", "vec_id:l, k:l, first:d3")
def _(spark, sf):
    (out,), k = sel.reduce_pca(matrix(spark, sf), MATRIX, 0.9)
    return out.select("vec_id", F.lit(k).alias("k"), F.abs(F.get("pca", 0)).alias("first"))


MI = """
with b as (select vec_id, dim, y, least(floor((x - lo) * 10 / (hi - lo)), 9) as bin from (
   select c.vec_id, dim, x, case when label = 0 then 1 else 0 end as y, min(x) over (partition by dim) as lo,
   max(x) over (partition by dim) as hi from cells c)),
j as (select dim, bin, y, count(*) as n from b group by 1, 2, 3),
m as (select *, sum(n) over (partition by dim) as t, sum(n) over (partition by dim, bin) as nb,
   sum(n) over (partition by dim, y) as ny from j)
select 'x' || dim as feature, sum(n / t * ln(n * t / (nb * ny))) as mi from m group by dim"""


@check("mutual_information", "feature:s, mi:d9", MI)
def _(spark, sf):
    return sel.mutual_information(matrix(spark, sf), MATRIX, "y")


@check("select_mrmr", "feature:s, corr:d4, kept:b")
def _(spark, sf):
    return names_frame(spark, sf, sel.select_mrmr(matrix(spark, sf), MATRIX, "y", 10))


@check("permutation_importance", "feature:s, drop:d4")
def _(spark, sf):
    m = matrix(spark, sf)
    return sel.permutation_importance(models.fit("LogReg", m, MATRIX, "y"), m, "vec_id", MATRIX, "y")


@check("single_feature_auc", "feature:s, auc:d9", """
with a as (select dim, sum(case when p.x > q.x then 1 when p.x = q.x then 0.5 else 0 end) / count(*) as a
  from cells p join cells q using (dim) where p.label = 0 and q.label <> 0 group by 1)
select 'x' || dim as feature, greatest(a, 1 - a) as auc from a""")
def _(spark, sf):
    return sel.single_feature_auc(matrix(spark, sf), MATRIX, "y")


@check("target_mean_auc", "feature:s, auc:d9", """
with b as (select dim, y, avg(y) over (partition by dim, bin) as enc from (
  select dim, case when label = 0 then 1 else 0 end as y, least(floor((x - min(x) over (partition by dim)) * 5
   / (max(x) over (partition by dim) - min(x) over (partition by dim))), 4) as bin from cells))
select 'x' || dim as feature, sum(case when p.enc > q.enc then 1 when p.enc = q.enc then 0.5 else 0 end) / count(*) as auc
from b p join b q using (dim) where p.y = 1 and q.y = 0 group by dim""")
def _(spark, sf):
    return sel.target_mean_auc(matrix(spark, sf), MATRIX, "y")


@check("selection_sweep", f"n:d1, n_features:l, {SCORE}")
def _(spark, sf):
    train, test = split(spark, sf)

    def score(names):
        return mt.binary_metrics(ex.scored("LDA", train, test, "vec_id", names, "y"), "y", "p")

    order = sel.select_mrmr(train, MATRIX, "y", 16)
    return sel.selection_sweep(lambda n: order[:int(n)], score, [4, 8, 16])


# --- models ---------------------------------------------------------------------------------

def _register_model(name, params):
    @check(f"model_{name.lower()}", f"model:s, {SCORE}")
    def run(spark, sf):
        train, test = split(spark, sf)
        pred = ex.scored(name, train, test, "vec_id", MATRIX, "y", params)
        return mt.binary_metrics(pred, "y", "p").withColumn("model", F.lit(name))


for _n, _p in (("LogReg", {"C": 1.0, "l1_ratio": 0.5}), ("RF", {"numTrees": 20, "maxDepth": 5}),
               ("EGB", {"maxIter": 10, "maxDepth": 3}), ("SVM", {"C": 1.0}), ("LDA", {"shrinkage": 0.1})):
    _register_model(_n, _p)


@check("logreg_optimal", "feature:s, optimal:b", """
select 'x' || i as feature, true as optimal from (select unnest(range(1, 65)) as i) union all select 'intercept', true""")
def _(spark, sf):
    """Whether the gradient of the penalized likelihood vanishes at the fitted coefficients, measured on the rows."""
    m = matrix(spark, sf)
    model = models.fit("LogReg", m, MATRIX, "y", {"C": 10.0, "tol": 1e-10, "maxIter": 500}).stages[-1]
    b, n = model.coefficients.toArray(), m.count()
    z = sum((F.col(c) * float(w) for c, w in zip(MATRIX, b)), F.lit(float(model.intercept)))
    off = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("y")
    rows = m.select(*MATRIX, off.alias("off"))
    slopes = [(c, F.avg(F.col("off") * F.col(c)) + float(w) / (10.0 * n)) for c, w in zip(MATRIX, b)] + [("intercept", F.avg("off"))]
    return rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(g) < 1e-6).alias("optimal")) for c, g in slopes]).alias("s")).select(F.inline("s"))


@check("lda_optimal", "feature:s, optimal:b", OPTIMAL)
def _(spark, sf):
    """Whether the covariance inside classes of each column with the score is the distance of the class means."""
    m = matrix(spark, sf)
    w, _ = models.lda_weights(m, MATRIX, "y")
    score = sum((F.col(c) * float(x) for c, x in zip(MATRIX, w)), F.lit(0.0))
    rows = m.select(*MATRIX, "y", score.alias("score"))
    by_class = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(c).alias("feature"), F.covar_pop(c, "score").alias("v"),
                                                                                      F.avg(c).alias("m")) for c in MATRIX]).alias("s"))
    each = by_class.select("y", "n", F.inline("s")).groupBy("feature").agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("inside"), F.sum(F.when(F.col("y") == 1, F.col("m")).otherwise(-F.col("m"))).alias("apart"))
    return each.select("feature", (F.abs(F.col("inside") - F.col("apart")) < 1e-9).alias("optimal"))


@check("tune", f"C:s, {SCORE}")
def _(spark, sf):
    train, test = split(spark, sf)
    model, params, _ = models.tune("LogReg", train, MATRIX, "y", n=10)
    pred = models.predict(model, test.select("vec_id", "y", *MATRIX))
    return mt.binary_metrics(pred, "y", "p").withColumn("C", F.lit(str(params["C"])))


@check("search_neighbours", "p:l, weights:s, k:l, f1:d", """
with r as (select vec_id, y, v, (row_number() over (partition by y order by md5(concat('42:', cast(vec_id as varchar))), vec_id) - 1) % 3 as fold from rows),
d as (select a.vec_id as id, a.fold, a.y as truth, b.y, b.vec_id as rid, list_distance(a.v, b.v) as d2,
  list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) as d1 from r a join r b on a.fold <> b.fold),
n as (select *, row_number() over (partition by p, id order by dist, rid) as k from (
  select 1 as p, id, fold, truth, y, rid, d1 as dist from d union all select 2, id, fold, truth, y, rid, d2 from d) qualify k <= 30),
v as (select p, k, fold, truth, avg(y) over w as uniform, sum(y / dist) over w / sum(1 / dist) over w as distance from n
  window w as (partition by p, id order by k rows between unbounded preceding and current row)),
l as (select p, k, fold, truth, unnest(['uniform', 'distance']) as weights, unnest([uniform, distance]) > 0.5 as hit from v where k >= 3),
f as (select p, weights, k, fold, count_if(hit and truth = 1) as tp, count_if(hit and truth <> 1) as fp, count_if(not hit and truth = 1) as fn
  from l group by 1, 2, 3, 4)
select p, weights, k, avg(case when tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end) as f1 from f group by 1, 2, 3""")
def _(spark, sf):
    m = matrix(spark, sf)
    return models.search_neighbours(cut(sampling.stratified_folds(m, "vec_id", "y", 3)), "vec_id", MATRIX, "y")


@check("median_parameters", "model:s, fold_id:l, f1_score:d, c:d, n_features:l", """
with r as (select *, row_number() over (partition by model order by f1, fold) as k, count(*) over (partition by model) as n from folds),
m as (select model, f1 as f1_median from r where k = n // 2 + 1),
o as (select m.model, min(fold) as fold, any_value(f1_median) as f1 from m join folds f on f.model = m.model and f.f1 = f1_median group by 1)
select model, fold as fold_id, f1 as f1_score, 0.5 + fold as c, 2 as n_features from o""")
def _(spark, sf):
    """Parameters of every model's median fold, written to one file a model and read back."""
    path = scratch(spark, "median")
    f = mt.binary_metrics(predictions(spark, sf), keys=["model", "fold"]).withColumns({
        "best_params": F.create_map(F.lit("C"), (F.col("fold") + 0.5).cast("string"), F.lit("weights"), F.lit("distance")),
        "selected_features": F.array(F.lit("a"), F.concat(F.lit("b"), "fold"))})
    store.write_median(f, path)
    rows = [(m, r["fold_id"], r["f1_score"], float(r["best_params"]["C"]), len(r["selected_features"])) for m, r in store.read_median(spark, path).items()]
    return spark.createDataFrame(rows, "model string, fold_id long, f1_score double, c double, n_features long")


@check("window_logistic", "trial_id:l, start:l, label:l, p:l, score:d3")
def _(spark, sf):
    w = sequences.sequence_windows(labelled(spark, sf), axis(spark, sf), ["sig_a", "sig_b"], "y", 12, 5)
    return models.window_scores(models.fit_window_logistic(w), w, 0.4)


# --- experiments ----------------------------------------------------------------------------

@check("cross_validate", f"model:s, fold:l, n_train:l, n_val:l, {SCORE}")
def _(spark, sf):
    return ex.cross_validate(matrix(spark, sf), "vec_id", MATRIX, "y", ["LDA", "KNN"], k=3, alphas=[1e-3])


@check("cross_validate_seq", f"model:s, fold:l, {SCORE}")
def _(spark, sf):
    return ex.cross_validate_seq(labelled(spark, sf), axis(spark, sf), ["sig_a", "sig_b"], "y", 3, 12, 5)


@check("cross_validate_seq_tuned", f"model:s, fold:l, method:l, length:l, step:l, threshold:d, {SCORE}")
def _(spark, sf):
    df = labelled(spark, sf).withColumnsRenamed({"sig_a": "a_v0", "sig_b": "b_v0"}).withColumn("a_v1", F.col("a_v0") - 1)
    space = {"method": ("pick", [0, 1]), "length": ("int", 8, 16), "step": ("int", 5, 9)}
    return ex.cross_validate_seq_tuned(df, axis(spark, sf), ["a_v0", "a_v1", "b_v0"], "y", 3, 3, 5, space=space)


@check("ablate", f"grp:s, model:s, fold:l, {SCORE}")
def _(spark, sf):
    return ex.ablate(matrix(spark, sf), "vec_id", {"low": MATRIX[:32], "high": MATRIX[32:]}, "y", ["LDA"], 3)


@check("horizon_sweep", f"horizon:l, fold:l, {SCORE}")
def _(spark, sf):
    return ex.horizon_sweep(labelled(spark, sf), axis(spark, sf), ["sig_a", "sig_b"], "y", [0, 3], 2, 12, 5)


@check("offset_sweep", "offset:l, n:l, n_pos:l", " union all ".join(f"""
select {o} as offset, count(*) as n, sum(y) as n_pos from (select p.trial_id, p.j, coalesce(max(s.y), 0) as y from (
   select trial_id, unnest(range(0, n)) as j from (select trial_id, greatest((max(t_s) - {o}) // {STRIDE}
     - ({WINDOW} // {STRIDE} - 1), 0) as n from signals group by 1)) p
 left join labelled s on s.trial_id = p.trial_id and s.t_s >= p.j * {STRIDE} + {o}
   and s.t_s < p.j * {STRIDE} + {o} + {WINDOW} group by 1, 2)""" for o in (0, OFFSET, 2 * OFFSET)))
def _(spark, sf):
    return ex.offset_sweep(labelled(spark, sf), axis(spark, sf), SLIDE, "y", [0, OFFSET, 2 * OFFSET]).groupBy(
        "offset").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@check("imbalance_study", f"variant:s, model:s, {SCORE}")
def _(spark, sf):
    train, test = split(spark, sf)
    return ex.imbalance_study(train, test, "vec_id", MATRIX, "y", ["LogReg"])


@check("reduction_study", f"method:s, model:s, n_features:l, {SCORE}")
def _(spark, sf):
    train, test = split(spark, sf)
    return ex.reduction_study(train, test, "vec_id", MATRIX, "y", ["LDA"], 6, alphas=[1e-3])


@check("user_groups", "sample_id:l, gap:d, level:d", """
select sample_id, sig_a - sig_b as gap, coalesce(sig_b, 1.2) as level from signals""")
def _(spark, sf):
    groups.register_group("gap", ["gap"], lambda df: df.withColumn("gap", F.col("sig_a") - F.col("sig_b")))
    groups.register_group("level", ["level"], lambda df: df.withColumn("level", F.coalesce("sig_b", F.lit(1.2))))
    return groups.apply_groups(signals(spark, sf), ["gap", "level"])


# --- attribution ----------------------------------------------------------------------------

LONG = """select vec_id as row_id, (case dim % 4 when 0 then 'EEG' when 1 then 'Pupil' when 2 then 'Brand#1 belt' else 'ECG lead' end)
    || '_v' || dim % 3 || '_x' || dim as feature, x * (dim - 32) as shap, x as data, vec_id % 2 as class from cells"""


def long_values(spark, sf):
    """Effects of 64 named features on every row of the matrix."""
    cells = matrix(spark, sf).select("vec_id", F.posexplode(F.array(*MATRIX)).alias("dim", "x")).withColumn("dim", F.col("dim") + 1)
    kind = F.array(*[F.lit(k) for k in ("EEG", "Pupil", "Brand#1 belt", "ECG lead")])[F.col("dim") % 4]
    return cells.select(
        F.col("vec_id").alias("row_id"), F.concat(kind, F.lit("_v"), F.col("dim") % 3, F.lit("_x"), "dim").alias("feature"),
        (F.col("x") * (F.col("dim") - 32)).alias("shap"), F.col("x").alias("data"),
        (F.col("vec_id") % 2).alias("class"))


@check("shapley_permutation", "row_id:l, feature:s, shap:d4, base_value:d4")
def _(spark, sf):
    train, test = split(spark, sf)
    model = models.fit("LogReg", train, MATRIX, "y")
    return at.shapley_permutation(at.probability_score(model), train, test, "vec_id", MATRIX)


@check("shapley_of_linear_score", "row_id:l, feature:s, shap:d6, base_value:d6, data:d9", """
with b as (select vec_id from rows where vec_id % 4 <> 0 order by md5(concat('42:b:', cast(vec_id as varchar))), vec_id limit 100),
t as (select vec_id from rows where vec_id % 4 = 0 order by md5(concat('42:t:', cast(vec_id as varchar))), vec_id limit 50),
m as (select dim, avg(x) as m from cells join b using (vec_id) group by 1)
select vec_id as row_id, 'x' || dim as feature, dim * 0.5 * (x - m) as shap, (select sum(dim * 0.5 * m) from m) as base_value, x as data
from cells join t using (vec_id) join m using (dim)""")
def _(spark, sf):
    """Permutation Shapley values (100 background and 50 test rows, all columns) of a score whose values are known."""
    train, test = split(spark, sf)
    linear = lambda df: df.withColumn("score", sum((F.col(c) * (0.5 * (i + 1)) for i, c in enumerate(MATRIX)), F.lit(0.0)))
    return at.shapley_permutation(linear, train, test, "vec_id", MATRIX)


@check("shapley_linear", "row_id:l, feature:s, shap:d9, data:d9", """
select vec_id as row_id, 'x' || dim as feature, dim * 0.5 * (x - avg(x) over (partition by dim)) as shap, x as data from cells""")
def _(spark, sf):
    coef = {c: 0.5 * (i + 1) for i, c in enumerate(MATRIX)}
    return at.shapley_linear(matrix(spark, sf), "vec_id", MATRIX, coef)


KEYS = {"eeg": "Brain", "_v1": "Early", "_v2": "Early", "pupil": "Eyes", "brand#1": "One"}
KEY_SQL = ("(select unnest(['eeg','_v1','_v2','pupil','brand#1']) as k, "
           "unnest(['Brain','Early','Early','Eyes','One']) as grp)")


def _group_sql(test, fn, long=LONG):
    return f"""
with l as ({long}), g as (select distinct feature, grp from (select distinct feature from l), {KEY_SQL} where {test})
select row_id, grp, {fn}(abs(shap)) as value, avg(data) as data, count(*) as matches from l join g using (feature)
group by 1, 2"""


# every name of the catalog in turn over the cells of the matrix
NAMED = """select vec_id as row_id, c.feature, x * (dim - 32) as shap, x as data, vec_id % 2 as class from cells join (
    select feature, row_number() over (order by feature) - 1 as place from catalog where feature is not null) c
  on c.place = (vec_id * 64 + dim - 1) % (select count(*) from catalog where feature is not null)"""


def catalog_values(spark, sf):
    """Effects on every cell of the matrix, named by the whole catalog in turn."""
    names = feature_catalog(spark, sf).where("feature is not null")
    placed = positions(*sorted_axis(names, ["feature"]), "place").select("feature", "place")
    cells = matrix(spark, sf).select("vec_id", F.posexplode(F.array(*MATRIX)).alias("dim", "x"))
    cells = attach_one(cells, placed.agg(F.count(F.lit(1)).alias("n"))).withColumn("place", F.expr("try_mod(vec_id * 64 + dim, n)"))
    return cells.join(placed, "place").select(
        F.col("vec_id").alias("row_id"), "feature", (F.col("x") * (F.col("dim") - 31)).alias("shap"), F.col("x").alias("data"),
        (F.col("vec_id") % 2).alias("class"))


@check("group_attribution_sum", "row_id:l, grp:s, value:d, data:d, matches:l",
       _group_sql("contains(lower(feature), k)", "sum", NAMED))
def _(spark, sf):
    return at.group_attribution(catalog_values(spark, sf), KEYS)


@check("group_attribution_mean", "row_id:l, grp:s, value:d, data:d, matches:l",
       _group_sql("starts_with(lower(feature), k)", "avg"))
def _(spark, sf):
    return at.group_attribution(long_values(spark, sf), KEYS, True, "mean_abs")


@check("group_stats", "grp:s, matches:l, mean_abs_mean:d, mean_abs_std:d, sum_abs_mean:d, sum_abs_std:d, total_abs:d3", f"""
with l as ({LONG}), g as (select distinct feature, grp from (select distinct feature from l), {KEY_SQL}
  where contains(lower(feature), k)),
r as (select row_id, grp, sum(abs(shap)) as s, avg(abs(shap)) as m, count(*) as k from l join g using (feature) group by 1, 2)
select grp, max(k) as matches, avg(m) as mean_abs_mean, stddev_pop(m) as mean_abs_std, avg(s) as sum_abs_mean,
  stddev_pop(s) as sum_abs_std, sum(s) as total_abs from r group by 1""")
def _(spark, sf):
    return at.group_stats(long_values(spark, sf), KEYS)


@check("select_class", "row_id:l, feature:s, shap:d9", f"select row_id, feature, shap from ({LONG}) where class = 1")
def _(spark, sf):
    return at.select_class(long_values(spark, sf), 1)


# --- sources and sinks ----------------------------------------------------------------------

SIGNAL_SCHEMA = "trial_code string, t_s double, sample_id long, sig_a double, sig_b double"


def _code(spark, sf):
    return signals(spark, sf).select(F.format_string("%02d-%02d", "subject_id", "trial_id").alias("trial_code"),
                                     F.col("t_s").cast("double"), "sample_id", "sig_a", "sig_b")


@check("read_signals", "subject:s, trial:s, sample_id:l, sig_a:d3, sig_b:d3", """
select printf('%02d', subject_id) as subject, printf('%02d', trial_id) as trial, sample_id,
  cast(cast(sig_a as float) as double) as sig_a, cast(cast(sig_b as float) as double) as sig_b from signals""")
def _(spark, sf):
    path = scratch(spark, "csv")
    odd = _code(spark, sf).withColumn("sig_a", F.coalesce("sig_a", F.lit(float("nan"))))
    odd.write.option("header", True).csv(path)
    return src.read_signals(spark, path, SIGNAL_SCHEMA, trial="trial_code", fmt="csv")


@check("materialize", "subject_id:l, sample_id:l, sig_a:d", "select subject_id, sample_id, sig_a from signals")
def _(spark, sf):
    path = scratch(spark, "columnar")
    store.materialize(signals(spark, sf), path, ["subject_id"], ["trial_id", "t_s"])
    return store.materialize(signals(spark, sf).limit(0), path)


@check("select_device", "sample_id:l, sig_a:d", "select sample_id, sig_a from signals")
def _(spark, sf):
    wide = signals(spark, sf).selectExpr("sample_id", "sig_a as `HR (bpm) - Belt`", "sig_b as `X - Other`")
    return src.select_device(wide, "Belt", ["sample_id"]).withColumnRenamed("HR (bpm) - Belt", "sig_a")


@check("read_side_files", "trial_id:s, n:l, total:d3", """
select printf('%02d-0%d', subject_id, trial_id % 7 + 1) as trial_id, count(*) as n, sum(sig_a) as total
from signals group by 1""")
def _(spark, sf):
    root = scratch(spark, "side")
    named = signals(spark, sf).withColumn("name", F.format_string(
        "rec_%02d_DC%d_x", "subject_id", F.col("trial_id") % 7 + 1)).select("name", "sample_id", "sig_a")
    # one folder per name on write; the folder name takes the place of the file name
    named.write.partitionBy("name").option("header", True).csv(root)
    side = src.read_side_files(spark, f"{root}/*/*.csv", "sample_id long, sig_a double")
    return side.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sig_a").alias("total"))


@check("read_band_baseline", "subject:s, band:s, channel:s, value:d", " union all ".join(f"""
select printf('%02d', row_number() over (order by s_suppkey)) as subject, '{b}' as band, '{c}' as channel,
  s_acctbal * {k} as value from supplier""" for b, c, k in (("delta", "Fz", 1), ("delta", "C3", 2), ("theta", "Fz", 3),
                                                           ("theta", "C3", 4))))
def _(spark, sf):
    root = scratch(spark, "bands")
    sup = table(spark, sf, "supplier").orderBy("s_suppkey")
    for i, band in enumerate(("delta", "theta")):
        sup.select((F.col("s_acctbal") * (2 * i + 1)).alias("Fz"), (F.col("s_acctbal") * (2 * i + 2)).alias("C3")) \
            .write.option("header", True).csv(f"{root}/EEG_baseline_{band}_all")
    return src.read_band_baseline(spark, f"{root}/*/*.csv")


@check("read_subject_dim", "subject:s, resting:d", """
select printf('%02d', row_number() over (order by s_suppkey)) as subject, s_acctbal as resting from supplier
qualify row_number() over (order by s_suppkey desc) > 1""")
def _(spark, sf):
    path = scratch(spark, "dim")
    table(spark, sf, "supplier").orderBy("s_suppkey").select(
        F.col("s_acctbal").alias("resting HR [seated]"), "s_name").write.option("header", True).csv(path)
    return src.read_subject_dim(spark, path, {"resting HR [seated]": "resting"}, drop_last=True)


@check("write_read_results", f"model:s, fold:l, {SCORE.split('tn:l, ')[1]}", """
select model, fold, accuracy, precision, recall, f1, specificity, g_mean from folds""")
def _(spark, sf):
    path = scratch(spark, "results")
    f = mt.binary_metrics(predictions(spark, sf), keys=["model", "fold"])
    store.write_results(store.nest_results(f, ["model", "fold"]), path, ["model"])
    back = store.read_results(spark, path, path_columns={"model": r"model=([^/]+)/"})
    return store.flatten_results(back)


@check("append_metrics", "model:l, fold:l, f1:d", "select model, fold, f1 from folds union all select model, fold, f1 from folds")
def _(spark, sf):
    path = scratch(spark, "metrics")
    f = mt.binary_metrics(predictions(spark, sf), keys=["model", "fold"]).select("model", "fold", "f1")
    store.append_metrics(f, path)
    store.append_metrics(f, path)
    return spark.read.option("header", True).schema("model long, fold long, f1 double").csv(path)


@check("cached_table", "sample_id:l, sig_a:d", "select sample_id, sig_a from signals")
def _(spark, sf):
    root = scratch(spark, "cache")
    made = lambda: signals(spark, sf).select("sample_id", "sig_a")
    store.cached(spark, root, {"k": 5, "fold": 0}, made)
    return store.cached(spark, root, {"fold": 0, "k": 5}, lambda: made().limit(0))


@check("save_load_model", f"{SCORE}")
def _(spark, sf):
    train, test = split(spark, sf)
    path = scratch(spark, "model")
    store.save_model(models.fit("LogReg", train, MATRIX, "y"), path)
    return mt.binary_metrics(models.predict(store.load_model(path), test.select("vec_id", "y", *MATRIX)), "y", "p")


@check("save_load_same", "n:l, differ:l", "select count(*) as n, 0 as differ from rows where vec_id % 4 = 0")
def _(spark, sf):
    """Rows whose prediction by the stored model is not that of the fitted one, on all columns."""
    train, test = split(spark, sf)
    path, model = scratch(spark, "model"), models.fit("LogReg", train, MATRIX, "y")
    store.save_model(model, path)
    rows = test.select("vec_id", *MATRIX)
    both = models.predict(model, rows).select("vec_id", "p").join(
        models.predict(store.load_model(path), rows).select("vec_id", F.col("p").alias("q")), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") != F.col("q")).alias("differ"))


# --- streams --------------------------------------------------------------------------------

BATCH = 32 << 20  # bytes of files in a micro-batch: as many as the recording's size asks for, however many files it has
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _staged(spark, sf, slices=(0, 1, 2, 3)):
    """The events table as a folder of files appended slice by slice (a recording to replay), and closed.

    Files of one slice hold different trials, so their order inside the slice does not matter.
    """
    path, events = scratch(spark, "recording"), table(spark, sf, "events")
    week = F.floor((F.dayofmonth("ts") - 1) / 8)
    for i in slices:
        events.where(week == i).repartition("user_id").write.mode("append").parquet(path)
    live.close_recording(spark, path, EVENT_SCHEMA, "ts", "60 days")
    return path


def _played(spark, sf, slices=(0, 1, 2, 3)):
    return live.replay(spark, _staged(spark, sf, slices), EVENT_SCHEMA, "ts", bytes_per_trigger=BATCH).selectExpr(
        "user_id as trial_id", "event_id as sample_id", "ts", "case when event_id % 7 = 0 then null else value end as sig_a")


def _drain(spark, df, name):
    out = scratch(spark, name)
    live.run_to_parquet(df, out, scratch(spark, name + "-cp"))
    return spark.read.parquet(out)


@check("stream_replay", "sample_id:l, trial_id:l, sig_a:d", "select sample_id, trial_id, sig_a from signals")
def _(spark, sf):
    return _drain(spark, _played(spark, sf).where("sample_id is not null"), "replay")


@check("stream_ffill", "sample_id:l, sig_a:d", """
select event_id as sample_id, coalesce(last_value(case when event_id % 7 = 0 then null else value end ignore nulls)
  over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0) as sig_a from events""")
def _(spark, sf):
    # files come in time order
    played = _played(spark, sf).where("sample_id is not null")
    return _drain(spark, live.ffill_stream(played, "trial_id", ["ts", "sample_id"], ["sig_a"]), "ffill")


@check("stream_ffill_events", "sample_id:l, sig_a:d", """
select event_id as sample_id, coalesce(last_value(case when event_id % 7 = 0 then null else value end ignore nulls)
  over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0) as sig_a from events""")
def _(spark, sf):
    """The recording's slices arrive out of order; rows wait for the watermark."""
    played = _played(spark, sf, (1, 0, 3, 2))
    return _drain(spark, live.ffill_events(played, "trial_id", "ts", ["sig_a"], "17 days", ["sample_id"], slice_seconds=86400.0), "ffill")


@check("stream_sliding_stats", "trial_id:l, t_begin:l, mean:d, std:d, max:d, range:d", f"""
with e as (select user_id as trial_id, epoch(ts) as t, case when event_id % 7 = 0 then null else value end as v from events),
w as (select trial_id, v, unnest(range(cast(floor(t / {STRIDE}) as bigint) - {WINDOW // STRIDE} + 1,
    cast(floor(t / {STRIDE}) as bigint) + 1)) * {STRIDE} as b from e)
select trial_id, b as t_begin, avg(v) as mean, stddev_pop(v) as std, max(v) as max, max(v) - min(v) as range
from w group by 1, 2""")
def _(spark, sf):
    df = live.sliding_stats_stream(_played(spark, sf), "trial_id", "ts", ["sig_a"], f"{WINDOW} seconds",
                                   f"{STRIDE} seconds", "691200 seconds")
    return _drain(spark, df, "sliding").select("trial_id", F.unix_timestamp("t_begin").alias("t_begin"), F.col(
        "sig_a_mean").alias("mean"), F.col("sig_a_stddev").alias("std"), F.col("sig_a_max").alias("max"),
        F.col("sig_a_range").alias("range"))


@check("stream_score", "vec_id:l, prediction:l")
def _(spark, sf):
    m = matrix(spark, sf).select("vec_id", "y", *MATRIX)
    path = scratch(spark, "rows")
    m.repartition(3).write.parquet(path)
    rows = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = live.score_stream(rows, models.fit("LogReg", m, MATRIX, "y"), MATRIX).select("vec_id", "prediction")
    return _drain(spark, out, "score")


@check("stream_window_scores", "n:l, differ:l", f"""
with w as (select user_id, unnest(range(cast(floor(epoch(ts) / {STRIDE}) as bigint) - {WINDOW // STRIDE} + 1,
    cast(floor(epoch(ts) / {STRIDE}) as bigint) + 1)) as b from events)
select count(*) as n, 0 as differ from (select distinct user_id, b from w)""")
def _(spark, sf):
    """Windows of the stream whose score by a stored model is not that of the batch windows."""
    cols, span = ["sig_a"], (f"{WINDOW} seconds", f"{STRIDE} seconds", "691200 seconds")
    played = _played(spark, sf)
    batch = table(spark, sf, "events").selectExpr("user_id as trial_id", "event_id as sample_id", "timestamp_micros(timestampdiff(MICROSECOND, "
        "timestamp_ntz'1970-01-01 00:00:00', ts)) as ts", "case when event_id % 7 = 0 then null else value end as sig_a")
    rows = live.window_features(batch, "trial_id", "ts", cols, *span)
    rows = rows.withColumn("y", (F.col("trial_id") % 3 == 0).cast("int"))
    names, path = live.feature_names(cols), scratch(spark, "model")
    model = models.fit("LogReg", rows, names, "y")
    store.save_model(model, path)
    streamed = _drain(spark, live.window_scores_stream(played, "trial_id", "ts", cols, *span, store.load_model(path)).select(
        "trial_id", "t_begin", "prediction"), "scores")
    both = models.predict(model, rows.select("trial_id", "t_begin", *names)).join(streamed, ["trial_id", "t_begin"], "full")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("prediction").eqNullSafe(F.col("p").cast("double"))).alias("differ"))


@check("stream_score_same", "n:l, differ:l", "select count(*) as n, 0 as differ from rows")
def _(spark, sf):
    """Rows whose streamed score by a stored model is not the batch prediction, on all columns."""
    m = matrix(spark, sf).select("vec_id", "y", *MATRIX)
    path, stored, model = scratch(spark, "rows"), scratch(spark, "model"), models.fit("LogReg", m, MATRIX, "y")
    m.repartition(3).write.parquet(path)
    store.save_model(model, stored)
    rows = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = live.score_stream(rows, store.load_model(stored), MATRIX).select("vec_id", "prediction")
    both = _drain(spark, out, "score").join(models.predict(model, m.select("vec_id", *MATRIX)).select("vec_id", "p"), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") != F.col("p")).alias("differ"))
