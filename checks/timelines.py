"""Events, baselines, derivatives, sliding windows and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspan.functions.sizing import cut
from trialspan.functions.timeline import positions, time_axis
from trialspan.operators import baseline as bl
from trialspan.operators import events as ev
from trialspan.operators import quality, sequences
from trialspan.operators import windows as win

from .base import CTES, EARLY, OFFSET, SHIFT, STRIDE, WINDOW, axis, check, resting, signals, table

ORD = "partition by trial_id order by t_s, sample_id"
SIG = ["sig_a", "sig_b"]
SLIDE = win.Slide(WINDOW, STRIDE, 0, OFFSET)


def labelled(spark, sf):
    return ev.label_intervals(signals(spark, sf), axis(spark, sf), "onset", "recovery", out="y")


CTES["placed"] = f"select *, row_number() over ({ORD}) - 1 as pos from signals"
CTES["ylab"] = f"select *, row_number() over ({ORD}) - 1 as pos from labelled"
CTES["spine"] = f"""
select trial_id, unnest(range(0, n)) as j from (
  select trial_id, greatest((max(t_s) - {OFFSET}) // {STRIDE} - ({WINDOW} // {STRIDE} - 1), 0) as n
  from signals group by 1)"""
CTES["early"] = f"""
select trial_id, case when count(sig_a) = count(*) then avg(sig_a) end as ma,
  case when count(sig_b) = count(*) then avg(sig_b) end as mb
from signals where t_s < {EARLY} group by 1"""
# window members, one row per (window, sample)
CTES["members"] = f"""
select p.trial_id, p.j, s.t_s, s.sample_id, s.sig_a, s.sig_b from spine p join signals s on s.trial_id = p.trial_id
  and s.t_s >= p.j * {STRIDE} and s.t_s < p.j * {STRIDE} + {WINDOW}"""
CTES["stats"] = f"""
select p.trial_id, p.j,
  avg(sig_a) as a_mean, stddev_pop(sig_a) as a_std, max(sig_a) as a_max, max(sig_a) - min(sig_a) as a_range,
  avg(sig_b) as b_mean, stddev_pop(sig_b) as b_std, max(sig_b) as b_max, max(sig_b) - min(sig_b) as b_range
from spine p left join members m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2"""
CTES["wlabel"] = f"""
select p.trial_id, p.j, coalesce(max(s.y), 0) as y from spine p left join labelled s on s.trial_id = p.trial_id
  and s.t_s >= p.j * {STRIDE} + {OFFSET} and s.t_s < p.j * {STRIDE} + {OFFSET} + {WINDOW} group by 1, 2"""
CTES["diffs"] = f"""
select trial_id, j, t_s, sample_id, sig_a - lag(sig_a) over w as da, sig_b - lag(sig_b) over w as db,
  60000 / nullif(sig_b + 40, 0) - lag(60000 / nullif(sig_b + 40, 0)) over w as dr
from members window w as (partition by trial_id, j order by t_s, sample_id)"""


@check("label_intervals", "sample_id:l, y:l", "select sample_id, y from labelled")
def _(spark, sf):
    return labelled(spark, sf)


@check("label_until", "sample_id:l, active:l", """
select s.sample_id, case when e.pos is not null and s.pos < e.pos and s.pos >= b.pos then 1 else 0 end as active
from placed s
left join (select trial_id, min(pos) as pos from placed where event = 'recovery' group by 1) e using (trial_id)
left join (select trial_id, min(pos) as pos from placed where event = 'onset' group by 1) b using (trial_id)""")
def _(spark, sf):
    return ev.label_until(signals(spark, sf), axis(spark, sf), "onset", "recovery")


SIDE = """
select user_id as trial_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value as v
from events where event_type = 'view'"""


@check("slot_in", "sample_id:l, sig_a:d", f"""
select p.sample_id, case when s.i is not null then s.v else p.sig_a end as sig_a from placed p
left join (select trial_id, min(pos) as m from placed where event = 'marker' group by 1) k using (trial_id)
left join ({SIDE}) s on s.trial_id = p.trial_id and s.i = p.pos - k.m""")
def _(spark, sf):
    side = table(spark, sf, "events").where("event_type = 'view'").selectExpr(
        "user_id as trial_id", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) as us", "event_id", "value as sig_a")
    ax = axis(spark, sf)
    step = float(ax.block.split(" / ")[1].split(")")[0]) * 1e6
    return ev.slot_in(signals(spark, sf), side, ax, time_axis("trial_id", "us", ("event_id",), step), "marker",
                      ["sig_a"])


@check("shift_label", "sample_id:l, y:l", f"select sample_id, lead(y, {SHIFT}, 0) over ({ORD}) as y from labelled")
def _(spark, sf):
    return ev.shift_label(labelled(spark, sf), axis(spark, sf), SHIFT, "y")


@check("prelabel", "sample_id:l, y:l", f"""
select sample_id, case when pos >= f - {SHIFT} and pos < f then 1 else y end as y
from (select *, min(case when y = 1 then pos end) over (partition by trial_id) as f from ylab)""")
def _(spark, sf):
    return ev.prelabel(labelled(spark, sf), axis(spark, sf), SHIFT, "y")


PEAK = """
select trial_id, arg_max(pos, (sig_a, -pos)) as peak_pos, max(sig_a) as peak_value
from placed where pos < 30 and sig_a is not null group by 1"""


def _placed(spark, sf):
    return positions(signals(spark, sf), axis(spark, sf), "pos")


@check("peak_row", "trial_id:l, peak_pos:l, peak_value:d", PEAK)
def _(spark, sf):
    return ev.peak_row(_placed(spark, sf), ["trial_id"], "sig_a", 30)


@check("nearest_row", "trial_id:l, near_pos:l, distance:d", f"""
select p.trial_id, arg_min(pos, (abs(sig_a - 10), pos)) as near_pos, min(abs(sig_a - 10)) as distance
from placed p join ({PEAK}) k on k.trial_id = p.trial_id and p.pos < k.peak_pos where sig_a is not null group by 1""")
def _(spark, sf):
    placed = _placed(spark, sf)
    targets = ev.peak_row(placed, ["trial_id"], "sig_a", 30).select("trial_id", "peak_pos", F.lit(10.0).alias("target"))
    return ev.nearest_row(placed, ["trial_id"], "sig_a", targets)


@check("first_equal_after", "trial_id:l, equal_pos:l", f"""
select p.trial_id, min(pos) as equal_pos from placed p
join ({PEAK}) k on k.trial_id = p.trial_id and p.pos >= k.peak_pos
join (select trial_id, max(pos) as last from placed group by 1) e on e.trial_id = p.trial_id and p.pos < e.last
where sig_b = 42 group by 1""")
def _(spark, sf):
    placed = _placed(spark, sf)
    peaks = ev.peak_row(placed, ["trial_id"], "sig_a", 30).select("trial_id", "peak_pos")
    return ev.first_equal_after(placed, ["trial_id"], "sig_b", peaks, 42)


@check("apply_event_rules", "sample_id:l, event:s", f"""
select p.sample_id, case when p.pos = e.pos then 'end' when p.pos = s.pos then 'start'
  when p.trial_id % 3 = 0 and p.trial_id % 2 = 0 and p.event = 'start' then null else p.event end as event
from (select * replace (case when event = 'marker' then 'start' else event end as event) from placed) p
left join (select p.trial_id, arg_min(pos, (abs(sig_a - (5 + p.trial_id % 4)), pos)) as pos from placed p
  join ({PEAK}) k on k.trial_id = p.trial_id and p.pos < k.peak_pos
  where sig_a is not null and p.trial_id % 3 = 0 group by 1) s on s.trial_id = p.trial_id
left join (select p.trial_id, min(pos) as pos from placed p
  join ({PEAK}) k on k.trial_id = p.trial_id and p.pos >= k.peak_pos
  join (select trial_id, max(pos) as last from placed group by 1) l on l.trial_id = p.trial_id and p.pos < l.last
  where floor(sig_a) = 12 and p.trial_id % 3 = 0 and p.trial_id % 5 = 0 group by 1) e on e.trial_id = p.trial_id""")
def _(spark, sf):
    df = signals(spark, sf).withColumn("event", F.when(F.col("event") == "marker", "start").otherwise(F.col("event")))
    df = df.withColumn("level", F.when(F.floor("sig_a") == 12, 12.0).otherwise(F.col("sig_a")))
    rules = df.where("trial_id % 3 = 0").select("trial_id").distinct().selectExpr(
        "trial_id", "double(5 + trial_id % 4) as g", "trial_id % 5 = 0 as add_end", "trial_id % 2 = 0 as clear_existing")
    # the start mark is searched on the signal itself, the end mark on the level
    starts = ev.apply_event_rules(df, axis(spark, sf), rules.withColumn("add_end", F.lit(False)), "sig_a", "start",
                                  "end", 12.0, 30)
    flat = ev.apply_event_rules(df.withColumn("tag", F.lit(None).cast("string")), axis(spark, sf), rules.withColumn(
        "g", F.lit(None).cast("double")), "level", "start", "end", 12.0, 30, end_col="tag").select("sample_id", "tag")
    return starts.join(flat, "sample_id").withColumn("event", F.coalesce("tag", "event"))


BASE_SQL = {
    "v0": "select sample_id, sig_a as a, sig_b as b from signals",
    "v1": """select sample_id, sig_a / coalesce(nullif(ma, 0), 1) as a, sig_b / coalesce(nullif(mb, 0), 1) as b
             from signals left join early using (trial_id)""",
    "v2": """select sample_id, sig_a - coalesce(ma, 0) as a, sig_b - coalesce(mb, 0) as b
             from signals left join early using (trial_id)""",
}
LATE = f"""
with t as (select trial_id, min(t_s) as T from signals where event = 'marker' group by 1),
l as (select s.trial_id, case when count(sig_a) = count(*) then avg(sig_a) end as la,
        case when count(sig_b) = count(*) then avg(sig_b) end as lb
      from signals s join t using (trial_id) where t_s > T - {EARLY} and t_s < T group by 1),
m as (select s.*, case when T is not null and t_s >= T - {EARLY} then la else ma end as ba,
        case when T is not null and t_s >= T - {EARLY} then lb else mb end as bb
      from signals s left join t using (trial_id) left join l using (trial_id) left join early using (trial_id))
"""
BASE_SQL["v3"] = LATE + "select sample_id, sig_a / nullif(ba, 0) as a, sig_b / nullif(bb, 0) as b from m"
BASE_SQL["v4"] = LATE + "select sample_id, sig_a - ba as a, sig_b - bb as b from m"
BASE_SQL["v5"] = """select sample_id, sig_a / nullif(coalesce(resting, 1), 0) as a, sig_b / nullif(coalesce(resting, 1), 0)
  as b from signals left join resting using (subject_id)"""
BASE_SQL["v6"] = """select sample_id, sig_a - coalesce(resting, 0) as a, sig_b - coalesce(resting, 0) as b
  from signals left join resting using (subject_id)"""
BANDS = """select 1 + s_suppkey as subject_id, case when s_nationkey % 5 = 0 then 0 else s_acctbal end as delta,
  s_acctbal / 2 as theta from supplier"""
BASE_SQL["v7"] = f"""select sample_id, case when delta = 0 then 0 else sig_a / delta end as a,
  case when theta = 0 then 0 else sig_b / theta end as b from signals left join ({BANDS}) using (subject_id)"""
BASE_SQL["v8"] = f"""select sample_id, case when delta = 0 then 0 else sig_a - delta end as a,
  case when theta = 0 then 0 else sig_b - theta end as b from signals left join ({BANDS}) using (subject_id)"""


def _bands(spark, sf):
    sup = table(spark, sf, "supplier")
    return sup.select((F.col("s_suppkey") + 1).alias("subject_id"), F.inline(F.array(
        F.struct(F.lit("C3").alias("channel"), F.lit("delta").alias("band"),
                 F.when(F.col("s_nationkey") % 5 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("value")),
        F.struct(F.lit("C3").alias("channel"), F.lit("theta").alias("band"),
                 (F.col("s_acctbal") / 2).alias("value")))))


def _sides(spark, sf):
    return dict(window=EARLY, event="event", marker="marker", resting=resting(spark, sf), bands=_bands(spark, sf),
                band_of={"sig_a": ("C3", "delta"), "sig_b": ("C3", "theta")})


def _register_baseline(method):
    @check(f"baseline_{method}", "sample_id:l, a:d, b:d", BASE_SQL[method])
    def run(spark, sf):
        out = bl.baseline(signals(spark, sf), method, SIG, axis(spark, sf), **_sides(spark, sf))
        return out.select("sample_id", F.col(f"sig_a_{method}").alias("a"), F.col(f"sig_b_{method}").alias("b"))


for _m in BASE_SQL:
    _register_baseline(_m)


@check("attach_subject", "sample_id:l, resting:d", """
select sample_id, resting from signals left join resting using (subject_id)""")
def _(spark, sf):
    from trialspan.functions.sizing import attach

    return attach(signals(spark, sf), resting(spark, sf), ["subject_id"])


def grad_sql(v: str, source: str) -> str:
    """np.gradient on an uneven axis, written with lag/lead over whole trials."""
    return f"""
select *, case when tm is null and tp is null then null
  when tm is null then (vp - {v}) / nullif(tp - t_s, 0)
  when tp is null then ({v} - vm) / nullif(t_s - tm, 0)
  else ((t_s - tm) * (t_s - tm) * vp + ((tp - t_s) * (tp - t_s) - (t_s - tm) * (t_s - tm)) * {v}
     - (tp - t_s) * (tp - t_s) * vm) / nullif((t_s - tm)::double * (tp - t_s) * (tp - tm), 0) end as g
from (select *, lag(t_s) over w as tm, lead(t_s) over w as tp, lag({v}) over w as vm, lead({v}) over w as vp
  from {source} window w as ({ORD}))"""


@check("gradient_first", "sample_id:l, g:d9", f"select sample_id, g from ({grad_sql('sig_a', 'signals')})")
def _(spark, sf):
    return bl.gradient(signals(spark, sf), axis(spark, sf), ["sig_a"]).select(
        "sample_id", F.col("sig_a_derivative").alias("g"))


@check("gradient_second", "sample_id:l, g:d9", "select sample_id, g from ({})".format(grad_sql(
    "g1", f"(select trial_id, sample_id, t_s, g as g1 from ({grad_sql('sig_a', 'signals')}))")))
def _(spark, sf):
    return bl.gradient(signals(spark, sf), axis(spark, sf), ["sig_a"], 2).select(
        "sample_id", F.col("sig_a_2derivative").alias("g"))


@check("combine_baselines", "sample_id:l, v0:d, v1:d, v2:d, v5:d, v6:d, d1:d9, d2:d9", "select * from ({})".format(f"""
select s.sample_id, s.sig_a as v0, s.sig_a / coalesce(nullif(ma, 0), 1) as v1, s.sig_a - coalesce(ma, 0) as v2,
  s.sig_a / nullif(coalesce(resting, 1), 0) as v5, s.sig_a - coalesce(resting, 0) as v6, a.g as d1, b.g as d2
from signals s left join early e on e.trial_id = s.trial_id left join resting r on r.subject_id = s.subject_id
join ({grad_sql('sig_a', 'signals')}) a on a.sample_id = s.sample_id
join ({grad_sql('g1', f"(select trial_id, sample_id, t_s, g as g1 from ({grad_sql('sig_a', 'signals')}))")}) b
  on b.sample_id = s.sample_id"""))
def _(spark, sf):
    plan = {m: ["sig_a"] for m in bl.METHODS["Complete"]}
    out = bl.combine_baselines(signals(spark, sf), axis(spark, sf), plan, **_sides(spark, sf))
    return out.select("sample_id", *[F.col(f"sig_a_{m}").alias(m) for m in plan],
                      F.col("sig_a_v0_derivative").alias("d1"), F.col("sig_a_v0_2derivative").alias("d2"))


@check("window_spine", "trial_id:l, window:l, t_begin:l, t_end:l", f"""
select trial_id, j as window, j * {STRIDE} as t_begin, j * {STRIDE} + {WINDOW} as t_end from spine""")
def _(spark, sf):
    return win.window_spine(signals(spark, sf), axis(spark, sf), SLIDE)


@check("sliding_stats", "trial_id:l, window:l, a_mean:d, a_std:d, a_max:d, a_range:d, b_mean:d, b_std:d, b_max:d, "
       "b_range:d", "select *, j as window from stats")
def _(spark, sf):
    w = win.sliding_stats(signals(spark, sf), axis(spark, sf), SLIDE, SIG)
    names = {"mean": "mean", "stddev": "std", "max": "max", "range": "range"}
    return w.select("trial_id", "window", *[F.col(f"sig_{c}_{k}").alias(f"{c}_{n}") for c in "ab"
                                            for k, n in names.items()])


@check("positions_null_key", "trial_id:l, sample_id:l, pos:l", """
with s as (select case when trial_id % 3 <> 0 then trial_id end as trial_id, case when sample_id % 5 <> 0 then t_s end as t_s, sample_id from signals)
select trial_id, sample_id, row_number() over (partition by trial_id order by t_s nulls first, sample_id) - 1 as pos from s""")
def _(spark, sf):
    s = signals(spark, sf).withColumns({"trial_id": F.when(F.col("trial_id") % 3 != 0, F.col("trial_id")),
                                        "t_s": F.when(F.col("sample_id") % 5 != 0, F.col("t_s"))})
    return positions(s, axis(spark, sf))


@check("sliding_stats_decimal", "trial_id:l, window:l, m:d, hi:d, r:d", """
with p as (select trial_id, sig_a, row_number() over (partition by trial_id order by t_s, sample_id) - 1 as i from signals),
n as (select trial_id, max(i) * 2 // 5 - 9 as n from p group by 1),
w as (select trial_id, unnest(range(n)) as j from n where n > 0)
select w.trial_id, j as window, avg(sig_a) as m, max(sig_a) as hi, max(sig_a) - min(sig_a) as r from w
join p on p.trial_id = w.trial_id and i * 2 >= j * 5 and i * 2 < j * 5 + 50 group by 1, 2""")
def _(spark, sf):
    """25 samples a second, windows of 1.0 s every 0.1 s: bounds that doubles do not hold exactly."""
    s = positions(signals(spark, sf), axis(spark, sf)).withColumn("t", F.col("pos") / F.lit(25.0))
    w = win.sliding_stats(s, time_axis("trial_id", "t", ("sample_id",), 40.0), win.Slide(1.0, 0.1), ["sig_a"])
    return w.select("trial_id", "window", F.col("sig_a_mean").alias("m"), F.col("sig_a_max").alias("hi"), F.col("sig_a_range").alias("r"))


@check("sliding_label", "trial_id:l, window:l, y:l", "select *, j as window from wlabel")
def _(spark, sf):
    return win.sliding_label(labelled(spark, sf), axis(spark, sf), SLIDE, "y")


@check("sliding_max", "trial_id:l, window:l, afe_max:d, y:l", """
select w.trial_id, w.j as window, max(s.afe) as afe_max, max(w.y) as y from wlabel w
left join (select m.*, afe from members m join signals using (sample_id)) s on s.trial_id = w.trial_id and s.j = w.j
group by 1, 2""")
def _(spark, sf):
    return win.sliding_max(labelled(spark, sf), axis(spark, sf), SLIDE, "afe", "y")


@check("hrv_sdnn", "trial_id:l, window:l, sdnn:d", """
select p.trial_id, p.j as window, stddev_pop(60000 / nullif(sig_b + 40, 0)) as sdnn from spine p
left join members m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2""")
def _(spark, sf):
    return _hrv(spark, sf)


def _hrv(spark, sf):
    df = signals(spark, sf).withColumn("bpm", F.col("sig_b") + 40)
    return win.hrv(df, axis(spark, sf), SLIDE, "bpm")


@check("hrv_rmssd", "trial_id:l, window:l, rmssd:d", """
select p.trial_id, p.j as window, sqrt(avg(dr * dr)) as rmssd from spine p
left join diffs m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2""")
def _(spark, sf):
    return _hrv(spark, sf)


@check("hrv_pnn50", "trial_id:l, window:l, pnn50:d", """
select p.trial_id, p.j as window, 100.0 * count(case when abs(dr) > 50 then 1 end) / nullif(count(dr), 0) as pnn50
from spine p left join diffs m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2""")
def _(spark, sf):
    return _hrv(spark, sf)


@check("edge_integral", "trial_id:l, window:l, integral:d3", f"""
select p.trial_id, p.j as window, {WINDOW / 2} * (arg_min_null(sig_a, (t_s, sample_id))
  + arg_max_null(sig_a, (t_s, sample_id))) as integral
from spine p left join members m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2""")
def _(spark, sf):
    return win.edge_integral(signals(spark, sf), axis(spark, sf), SLIDE, ["sig_a"]).select(
        "trial_id", "window", F.col("sig_a_integral").alias("integral"))


@check("diff_stats", "trial_id:l, window:l, a_mean:d, a_max:d, a_sum:d, b_mean:d, b_max:d, b_sum:d", """
select p.trial_id, p.j as window, avg(da) as a_mean, max(da) as a_max, coalesce(sum(da), 0) as a_sum,
  avg(db) as b_mean, max(db) as b_max, coalesce(sum(db), 0) as b_sum
from spine p left join diffs m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2""")
def _(spark, sf):
    w = win.diff_stats(signals(spark, sf), axis(spark, sf), SLIDE, SIG)
    return w.select("trial_id", "window", *[F.col(f"sig_{c}_diff_{k}").alias(f"{c}_{k}") for c in "ab"
                                            for k in ("mean", "max", "sum")])


@check("ies", "trial_id:l, window:l, ies:d", "select trial_id, j as window, a_mean / nullif(b_mean, 0) as ies from stats")
def _(spark, sf):
    return win.ies(signals(spark, sf), axis(spark, sf), SLIDE, "sig_a", "sig_b")


@check("zscore_trial", "trial_id:l, window:l, z:d", """
select trial_id, j as window, case when sd = 0 then 0 else (a_mean - m) / sd end as z from (
  select *, avg(a_mean) over (partition by trial_id) as m, stddev_pop(a_mean) over (partition by trial_id) as sd
  from stats)""")
def _(spark, sf):
    w = win.sliding_features(signals(spark, sf), axis(spark, sf), SLIDE, ["sig_a"], stats=("mean",))
    return win.zscore(w.withColumnRenamed("sig_a_mean", "z"), ["z"], ["trial_id"], zero=0)


@check("zscore_all", "trial_id:l, window:l, z:d", """
select trial_id, j as window, (a_mean - (select avg(a_mean) from stats))
  / nullif((select stddev_pop(a_mean) from stats), 0) as z from stats""")
def _(spark, sf):
    w = win.sliding_features(signals(spark, sf), axis(spark, sf), SLIDE, ["sig_a"], stats=("mean",))
    return win.zscore(w.withColumnRenamed("sig_a_mean", "z"), ["z"])


@check("feature_matrix", "trial_id:l, window:l, y:l, m1:d, m2:d, s1:d, s2:d, r1:d, h2:d, d1:d", """
with f as (select s.*, w.y, h.hs, h.dm from stats s join wlabel w using (trial_id, j) join (
    select p.trial_id, p.j, sqrt(avg(dr * dr)) as hs, avg(da) as dm from spine p
    left join diffs m on m.trial_id = p.trial_id and m.j = p.j group by 1, 2) h using (trial_id, j))
select trial_id, j as window, y,
  case when stddev_pop(a_mean) over t = 0 then 0 else (a_mean - avg(a_mean) over t) / stddev_pop(a_mean) over t end as m1,
  (a_mean - avg(a_mean) over ()) / stddev_pop(a_mean) over () as m2,
  case when stddev_pop(b_std) over t = 0 then 0 else (b_std - avg(b_std) over t) / stddev_pop(b_std) over t end as s1,
  (b_std - avg(b_std) over ()) / stddev_pop(b_std) over () as s2,
  case when stddev_pop(a_range) over t = 0 then 0 else (a_range - avg(a_range) over t) / stddev_pop(a_range) over t
    end as r1,
  (hs - avg(hs) over ()) / stddev_pop(hs) over () as h2,
  case when stddev_pop(dm) over t = 0 then 0 else (dm - avg(dm) over t) / stddev_pop(dm) over t end as d1
from f window t as (partition by trial_id)""")
def _(spark, sf):
    df = labelled(spark, sf).withColumn("bpm", F.col("sig_b") + 40)
    w = win.feature_matrix(df, axis(spark, sf), SLIDE, SIG, "y", rate="bpm", pupils=["sig_a"])
    return w.selectExpr("trial_id", "window", "y", "sig_a_mean_s1 as m1", "sig_a_mean_s2 as m2", "sig_b_stddev_s1 as s1",
                        "sig_b_stddev_s2 as s2", "sig_a_range_s1 as r1", "hrv_rmssd_s2 as h2", "sig_a_diff_mean_s1 as d1")


CTES["seqs"] = """
select a.trial_id, a.pos as start, list(b.sig_a order by b.pos) as seq, list(b.y order by b.pos) as ys,
  max(case when b.pos = a.pos + 11 then b.y end) as y_end
from ylab a join ylab b on b.trial_id = a.trial_id and b.pos between a.pos and a.pos + 11
where a.pos % 5 = 0 group by 1, 2 having count(*) = 12"""


@check("sequence_windows", "trial_id:l, start:l, seq:s, label:l, labels:s", """
select trial_id, start, array_to_string(list_transform(seq, lambda v: coalesce(cast(cast(round(v * 100) as bigint)
   as varchar), '-')), ',') as seq, y_end as label, array_to_string(ys, ',') as labels from seqs""")
def _(spark, sf):
    df, ax = labelled(spark, sf), axis(spark, sf)
    a = sequences.sequence_windows(df, ax, ["sig_a"], "y", 12, 5)
    b = sequences.sequence_windows(df, ax, ["sig_a"], "y", 12, 5, end_label=False)
    text = F.array_join(F.transform(F.flatten("rows"), lambda v: F.coalesce(
        F.round(v * 100).cast("bigint").cast("string"), F.lit("-"))), ",")
    return a.withColumn("seq", text).join(
        b.select("trial_id", "start", F.array_join("label", ",").alias("labels")), ["trial_id", "start"])


@check("forecast_windows", "trial_id:l, start:l, n:l, label:l", """
select s.trial_id, s.start, len(s.seq) as n, f.y as label from seqs s
join ylab f on f.trial_id = s.trial_id and f.pos = s.start + 11 + 4""")
def _(spark, sf):
    w = sequences.sequence_windows(labelled(spark, sf), axis(spark, sf), ["sig_a"], "y", 12, 5, horizon=4)
    return w.withColumn("n", F.size("rows"))


@check("window_mean_summary", "trial_id:l, start:l, sig_a:d, label:l", """
select trial_id, start, list_avg(seq) as sig_a, y_end as label from seqs""")
def _(spark, sf):
    w = sequences.sequence_windows(labelled(spark, sf), axis(spark, sf), ["sig_a"], "y", 12, 5)
    return sequences.window_mean_summary(w, ["trial_id"], ["sig_a"])


@check("ffill", "sample_id:l, sig_a:d, sig_b:d", f"""
select sample_id, coalesce(last_value(sig_a ignore nulls) over w, 0) as sig_a,
  coalesce(last_value(sig_b ignore nulls) over w, 0) as sig_b from signals
window w as ({ORD} rows between unbounded preceding and current row)""")
def _(spark, sf):
    return sequences.ffill(signals(spark, sf), axis(spark, sf), SIG)


@check("flagship_window_labels", "y:l, n:l, percent:d, event_rate:d, mean_v1:d", """
with b as (select s.trial_id, s.t_s, s.sig_a / coalesce(nullif(ma, 0), 1) as v from signals s left join early using (trial_id)),
w as (select p.trial_id, p.j, avg(v) as m from spine p left join b on b.trial_id = p.trial_id
   and b.t_s >= p.j * 43200 and b.t_s < p.j * 43200 + 172800 group by 1, 2)
select y, count(*) as n, round(100.0 * count(*) / (select count(*) from wlabel), 2) as percent,
  (select avg(y) from wlabel) as event_rate, avg(m) as mean_v1
from wlabel join w using (trial_id, j) group by 1""")
def flagship(spark, sf):
    """Label intervals, v1 baseline, sliding mean with window label, label distribution."""
    ax = axis(spark, sf)
    df = labelled(spark, sf).select("trial_id", "t_s", "sample_id", "sig_a", "y")
    base = cut(bl.baseline(df, "v1", ["sig_a"], ax, window=EARLY))
    w = cut(win.sliding_features(base, ax, SLIDE, ["sig_a_v1"], label="y", stats=("mean",)))
    means = w.groupBy("y").agg(F.avg("sig_a_v1_mean").alias("mean_v1"))
    return quality.label_distribution(w, "y").join(means, "y")
