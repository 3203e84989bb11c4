"""Folds, resampling, nearest neighbours, imputation and scaling on the embedding matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.operators import impute as im
from trialspan.operators import neighbours as nb
from trialspan.operators import sampling as sm

from .base import CTES, MATRIX, check, matrix

CTES["rows"] = """select vec_id, label, case when label = 0 then 1 else 0 end as y, vec_id % 20 as grp,
  cast(embedding as double[]) as v from embeddings"""
U = "cast(concat('0x', substr(md5({}), 1, 13)) as bigint) / 4503599627370496.0"
CTES["means"] = "select dim, avg(case when hole = 0 then x end) as m from cells group by 1"
CTES["trainmeans"] = "select dim, avg(case when hole = 0 then x end) as m from cells where vec_id % 5 <> 0 group by 1"
CTES["filled"] = """select vec_id, dim, hole, case when hole = 1 then m else x end as x from cells join means using (dim)"""
CTES["filledt"] = """select vec_id, dim, hole, case when hole = 1 then m else x end as x from cells
  join trainmeans using (dim)"""
CTES["fvec"] = "select vec_id, max(hole) as q, list(x order by dim) as v from filled group by 1"
CTES["fvect"] = "select vec_id, max(hole) as q, list(x order by dim) as v from filledt group by 1"
NEAR = """select a.vec_id as id, b.vec_id as rid, list_distance(a.v, b.v) as dist,
  row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rank"""


@check("stratified_folds", "vec_id:l, y:l, fold:l", """
select vec_id, y, (row_number() over (partition by y order by md5(concat('42:', cast(vec_id as varchar))), vec_id) - 1) % 5
  as fold from rows""")
def _(spark, sf):
    return sm.stratified_folds(matrix(spark, sf).select("vec_id", "y"), "vec_id", "y", 5)


@check("stratified_folds_null", "vec_id:l, y:l, fold:l", """
with r as (select vec_id, case when vec_id % 4 <> 0 then y end as y from rows)
select vec_id, y, (row_number() over (partition by y order by md5(concat('42:', cast(vec_id as varchar))), vec_id) - 1) % 5
  as fold from r""")
def _(spark, sf):
    m = matrix(spark, sf).select("vec_id", F.when(F.col("vec_id") % 4 != 0, F.col("y")).alias("y"))
    return sm.stratified_folds(m, "vec_id", "y", 5)


@check("group_folds", "vec_id:l, fold:l", """
with g as (select grp, sum(y) as p, md5(concat('42:', cast(grp as varchar))) as h from rows group by 1),
r as (select grp, row_number() over (partition by p > 0 order by p desc, h, grp) - 1 as r from g)
select vec_id, case when (r // 4) % 2 = 1 then 3 - r % 4 else r % 4 end as fold from rows join r using (grp)""")
def _(spark, sf):
    return sm.group_folds(matrix(spark, sf).select("vec_id", "y", "grp"), "grp", "y", 4)


@check("random_split", "vec_id:l, is_test:l", """
select vec_id, case when row_number() over (order by md5(concat('42:', cast(vec_id as varchar))), vec_id)
  <= ceil(0.3 * (select count(*) from rows)) then 1 else 0 end as is_test from rows""")
def _(spark, sf):
    return sm.random_split(matrix(spark, sf).select("vec_id", "y"), "vec_id", 0.3)


@check("group_holdout", "vec_id:l, is_test:l", """
with g as (select grp, row_number() over (order by md5(concat('42:', cast(grp as varchar))), grp) as r
  from (select distinct grp from rows))
select vec_id, case when r <= ceil(0.2 * (select count(*) from g)) then 1 else 0 end as is_test from rows join g using (grp)""")
def _(spark, sf):
    return sm.group_holdout(matrix(spark, sf).select("vec_id", "grp"), "grp", 0.2)


RANKED = """select *, row_number() over (partition by y order by md5(concat('42:', cast(vec_id as varchar))), vec_id) - 1
  as r, count(*) over (partition by y) as n from rows"""


@check("undersample", "vec_id:l, y:l", f"""
with k as ({RANKED}) select vec_id, y from k where r < (select min(n) from k)""")
def _(spark, sf):
    return sm.undersample(matrix(spark, sf).select("vec_id", "y"), "vec_id", "y")


@check("oversample", "vec_id:l, y:l, copy:l", f"""
with k as ({RANKED}), m as (select max(n) as m from k)
select vec_id, y, unnest(range(0, cast(m // n + case when r < m % n then 1 else 0 end as bigint))) as copy from k, m""")
def _(spark, sf):
    return sm.oversample(matrix(spark, sf).select("vec_id", "y"), "vec_id", "y")


@check("oversample_draws", "vec_id:l, y:l, copy:l", f"""
with k as ({RANKED}), m as (select max(n) as m from k),
s as (select vec_id as slot, y, n, unnest(range(1, cast((m - n) // n + case when r < (m - n) % n then 1 else 0 end as bigint) + 1)) as copy from k, m)
select vec_id, y, 0 as copy from k union all
select k.vec_id, k.y, s.copy from s join k on k.y = s.y
  and k.r = floor({U.format("concat('42:d:', cast(slot as varchar), ':', cast(copy as varchar))")} * s.n)""")
def _(spark, sf):
    return sm.oversample(matrix(spark, sf).select("vec_id", "y"), "vec_id", "y", replacement=True)


SMOTE = """
with mi as (select vec_id, v, row_number() over (order by md5(concat('42:', cast(vec_id as varchar))), vec_id) - 1 as r
  from rows where y = 1),
c as (select (select count(*) from rows where y <> 1) - (select count(*) from mi) as new, (select count(*) from mi) as a),
s as (select vec_id, v, unnest(range(0, cast(new // a + case when r < new % a then 1 else 0 end as bigint))) as copy from mi, c),
nn as (""" + NEAR + """ from mi a join mi b on a.vec_id <> b.vec_id qualify rank <= 7),
p as (select s.*, cast(floor(""" + U.format("concat('42:n:', cast(vec_id as varchar), ':', cast(copy as varchar))") + """ * 7) as int) + 1
   as rank, """ + U.format("concat('42:u:', cast(vec_id as varchar), ':', cast(copy as varchar))") + """ as u from s)
select p.vec_id, 1 as y, p.copy, p.v[1] + u * (b.v[1] - p.v[1]) as x1, p.v[64] + u * (b.v[64] - p.v[64]) as x64
from p join nn on nn.id = p.vec_id and nn.rank = p.rank join mi b on b.vec_id = nn.rid
union all select vec_id, y, -1, v[1], v[64] from rows"""


@check("smote", "vec_id:l, y:l, copy:l, x1:d, x64:d", SMOTE)
def _(spark, sf):
    return sm.smote(matrix(spark, sf), "vec_id", "y", MATRIX)


@check("weighted_sample", "draw:l, vec_id:l, y:l", f"""
with k as ({RANKED}), s as (select max(case when y = 0 then n end) as n0, max(case when y = 1 then n end) as n1 from k),
d as (select unnest(range(0, (select count(*) from rows))) as draw),
e as (select draw, case when {U.format("concat('42:c:', cast(draw as varchar))")} < n0 * 1.0 / (n0 * 1.0 + n1 * 5.0) then 0
  else 1 end as y, {U.format("concat('42:r:', cast(draw as varchar))")} as u, n0, n1 from d, s)
select draw, k.vec_id, k.y from e join k on k.y = e.y and k.r = floor(u * case when e.y = 0 then n0 else n1 end)""")
def _(spark, sf):
    return sm.weighted_sample(matrix(spark, sf).select("vec_id", "y"), "vec_id", "y", {0: 1.0, 1: 5.0})


@check("knn_join", "id:l, rid:l, dist:d, rank:l", NEAR + """
from rows a join rows b on a.vec_id % 5 = 0 and b.vec_id % 5 <> 0 qualify rank <= 5""")
def _(spark, sf):
    v = nb.vectors(matrix(spark, sf), "vec_id", MATRIX)
    return nb.knn_join(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), 5)


@check("knn_join_approx", "n_queries:l, recall_ok:b",
       "select count(*) as n_queries, true as recall_ok from embeddings where vec_id % 20 = 0")
def _(spark, sf):
    """Recall of the hashed index at k = 5, against the exact join of every twentieth row with all rows."""
    v = nb.vectors(matrix(spark, sf), "vec_id", MATRIX)
    found, exact = (nb.knn_join(v.where("id % 20 = 0"), v, 5, skip_self=True, mode=m) for m in ("approx", "exact"))
    return nb.recall_of(found, exact).withColumn("recall_ok", F.col("recall") >= 0.9)


@check("knn_classify", "vec_id:l, score:d, prediction:l", f"""
with nn as ({NEAR}, b.y from rows a join rows b on a.vec_id % 5 = 0 and b.vec_id % 5 <> 0 qualify rank <= 7)
select id as vec_id, sum(y / dist) / sum(1 / dist) as score,
  case when sum(y / dist) / sum(1 / dist) > 0.5 then 1 else 0 end as prediction from nn group by 1""")
def _(spark, sf):
    m = matrix(spark, sf)
    return nb.knn_classify(m.where("vec_id % 5 <> 0"), m.where("vec_id % 5 = 0"), "vec_id", MATRIX, "y", 7, "distance")


def long_cells(df):
    return df.select("vec_id", F.posexplode(F.array(*MATRIX)).alias("dim", "x")).withColumn("dim", F.col("dim") + 1)


@check("fill_mean", "vec_id:l, dim:l, x:d", "select vec_id, dim, x from filledt")
def _(spark, sf):
    m = matrix(spark, sf, holes=True).withColumn("train", F.expr("int(vec_id % 5 <> 0)"))
    return long_cells(im.fill_mean(m, MATRIX, "train"))


@check("knn_impute", "vec_id:l, dim:l, x:d", f"""
with nn as ({NEAR} from fvec a join fvec b on a.vec_id <> b.vec_id and a.q = 1 qualify rank <= 5),
val as (select id as vec_id, dim, avg(x) as k from nn join filled f on f.vec_id = nn.rid group by 1, 2)
select c.vec_id, c.dim, case when c.hole = 1 then k else c.x end as x from cells c left join val using (vec_id, dim)""")
def _(spark, sf):
    return long_cells(im.knn_impute(matrix(spark, sf, holes=True), "vec_id", MATRIX, 5))


@check("knn_impute_approx", "vec_id:l, n_null:l, n_kept:l", """
select vec_id, 0 as n_null, count_if(hole = 0) as n_kept from cells group by 1""")
def _(spark, sf):
    """Every missing cell is filled and every other cell stays as it was."""
    m = matrix(spark, sf, holes=True)
    out = long_cells(im.knn_impute(m, "vec_id", MATRIX, 5, mode="approx")).join(
        long_cells(m).withColumnRenamed("x", "was"), ["vec_id", "dim"])
    return out.groupBy("vec_id").agg(F.count_if(F.col("x").isNull()).alias("n_null"), F.count_if(F.col("x") == F.col("was")).alias("n_kept"))


@check("knn_impute_train", "vec_id:l, dim:l, x:d", f"""
with nn as ({NEAR} from fvect a join fvect b on a.vec_id <> b.vec_id and a.q = 1 and b.vec_id % 5 <> 0
  qualify rank <= 5),
val as (select id as vec_id, dim, avg(x) as k from nn join filledt f on f.vec_id = nn.rid group by 1, 2)
select c.vec_id, c.dim, case when c.hole = 1 then k else c.x end as x from cells c left join val using (vec_id, dim)""")
def _(spark, sf):
    m = matrix(spark, sf, holes=True).withColumn("train", F.expr("int(vec_id % 5 <> 0)"))
    return long_cells(im.knn_impute(m, "vec_id", MATRIX, 5, "train"))


# nearest donors over shared coordinates; {m} and {s} shift and scale a column's values
SHARED = """
with u as (select dim, avg(case when hole = 0 then x end) as m, coalesce(nullif(stddev_pop(case when hole = 0 then x end), 0), 1) as s from cells group by 1),
c as (select vec_id, dim, case when hole = 0 then x end as x, case when hole = 0 then {value} end as z, {m} as m, {s} as s from cells join u using (dim)),
v as (select vec_id, list(z order by dim) as z, bool_or(z is null) as q from c group by 1),
d as (select a.vec_id as id, b.vec_id as rid, list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])) as sq
  from v a join v b on a.q and a.vec_id <> b.vec_id),
e as (select id, rid, sqrt(list_sum(sq) * 64 / list_count(sq)) as dist from d where list_count(sq) > 0),
k as (select h.vec_id, h.dim, b.z, row_number() over (partition by h.vec_id, h.dim order by e.dist, e.rid) as r
  from c h join e on e.id = h.vec_id join c b on b.vec_id = e.rid and b.dim = h.dim and b.z is not null where h.x is null),
f as (select vec_id, dim, avg(z) as k from k where r <= 5 group by 1, 2)
select vec_id, dim, coalesce(x, k * s + m) as x from c left join f using (vec_id, dim)"""


@check("knn_impute_shared", "vec_id:l, dim:l, x:d", SHARED.format(value="x", m="0.0", s="1.0"))
def _(spark, sf):
    return long_cells(im.knn_impute_shared(matrix(spark, sf, holes=True), "vec_id", MATRIX, 5))


@check("knn_impute_scaled", "vec_id:l, dim:l, x:d", SHARED.format(value="(x - m) / s", m="m", s="s"))
def _(spark, sf):
    return long_cells(im.knn_impute_shared(matrix(spark, sf, holes=True), "vec_id", MATRIX, 5, scaled=True))


@check("missing_indicators", "vec_id:l, dim:l, x:l", "select vec_id, dim, hole as x from cells")
def _(spark, sf):
    m = im.missing_indicators(matrix(spark, sf, holes=True), MATRIX)
    return m.select("vec_id", F.posexplode(F.array(*[f"{c}_missing" for c in MATRIX])).alias("dim", "x")).withColumn(
        "dim", F.col("dim") + 1)


@check("selective_indicators", "vec_id:l, n_kept:l, n_missing:l")
def _(spark, sf):
    m, kept = im.selective_indicators(matrix(spark, sf, holes=True), MATRIX)
    made = [F.col(f"{c}_missing") for c in kept]
    return m.select("vec_id", F.lit(len(kept)).alias("n_kept"), sum(made, F.lit(0)).alias("n_missing"))


@check("impute_selective", "vec_id:l, n_null:l, n_same:l, marks_ok:b", """
select vec_id, 0 as n_null, count_if(hole = 0) as n_same, true as marks_ok from cells group by 1""")
def _(spark, sf):
    """Indicators stay what they were before the cells were filled."""
    m = matrix(spark, sf, holes=True)
    made, kept = im.impute_selective(m, "vec_id", MATRIX, scaled=True)
    was = m.select(F.col("vec_id"), F.array(*MATRIX).alias("was"), F.array(*[F.col(c).isNull().cast("int") for c in kept]).cast("array<int>").alias("holes"))
    both = made.select("vec_id", F.array(*MATRIX).alias("now"), F.array(*[F.col(f"{c}_missing") for c in kept]).cast("array<int>").alias("marks")).join(was, "vec_id")
    same = F.size(F.filter(F.arrays_zip("now", "was"), lambda x: x["now"] == x["was"]))
    return both.select("vec_id", F.size(F.filter("now", lambda x: x.isNull())).alias("n_null"), same.alias("n_same"), (F.col("marks") == F.col("holes")).alias("marks_ok"))


@check("impute_phases", "phase:s, n_rows:l, n_null:l", """
select unnest(['none', 'pre_feature', 'post_feature_remove_rows', 'post_feature_knn']) as phase,
  unnest([(select count(*) from rows), (select count(*) from rows),
     (select count(*) from rows) - (select count(distinct vec_id) from cells where hole = 1),
     (select count(*) from rows)]) as n_rows,
  unnest([(select count(*) from cells where hole = 1), 0, 0, 0]) as n_null""")
def _(spark, sf):
    cols, out = MATRIX, None
    for phase in im.PHASES:
        m = matrix(spark, sf, holes=True).select("vec_id", *cols)
        m = im.impute(im.impute(m, phase, "raw", "vec_id", cols), phase, "windows", "vec_id", cols)
        one = m.agg(F.count(F.lit(1)).alias("n_rows"),
                    sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias("n_null")).withColumn(
            "phase", F.lit(phase))
        out = one if out is None else out.unionByName(one)
    return out


@check("standardize", "vec_id:l, dim:l, x:d", """
select vec_id, dim, (x - m) / coalesce(nullif(s, 0), 1) as x from cells join (
  select dim, avg(x) as m, stddev_pop(x) as s from cells where vec_id % 5 <> 0 group by 1) using (dim)""")
def _(spark, sf):
    m = matrix(spark, sf).withColumn("train", F.expr("int(vec_id % 5 <> 0)"))
    return long_cells(im.standardize(m, MATRIX, "train"))
