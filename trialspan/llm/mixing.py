r"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed by cell (source, language, topic). A sweep scales the cells' weights to each target marginal in turn,
where no cell may take more tokens than it has. Sweeps go on until all marginals are met within ``TOLERANCE`` of the
sample, or until ``PATIENCE`` of them no longer halve the error: then no sample meets all targets, and a warning tells how
far a marginal is off. A document is sampled with the calibrated probability of its cell, weight / tokens there, against
a uniform number made of its id, so the choice repeats on any cluster. A target above all tokens of its category takes
the whole category and leaves the rest of its share to the others of its dimension in proportion to their targets; a
warning tells this as well. All sweeps work on the cell table, in one partition if it is counted to be small; documents
are only counted and joined to their cell.

Defined cases: a null source, language or topic is the category ''; a null text has no tokens; documents of a
cell without tokens, or whose target is 0, have probability 0; rows that repeat an id share their number, hence
their fate; a null id has one of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_counted, read, small, stored

WORD = r"[^\x20\x09-\x0D]+"
SWEEPS = 12  # fewest
STEP = 4  # sweeps between two looks at the error
PATIENCE = 20  # sweeps that have to halve the error
BUDGET = 0.7  # share of all tokens
TOLERANCE = 1e-6  # error of a marginal, as a share of the sample
ONE_PARTITION = 20_000  # cells
ALPHA = 0.7  # a category with n tokens aims at a share in proportion to n ** ALPHA


def uniform(id_: Column, seed: int = 42) -> Column:
    """Number in [0, 1) of an id: 52 bits of an md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """(dim, share): targets that flatten the present token counts of a dimension; shares need not sum to 1."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias("share"))


def filled(df: DataFrame, part: list[str], weight: str, bound: str, goal: str) -> DataFrame:
    """Scale ``weight`` in each part by the factor that makes the sum of least(bound, weight) the part's goal.

    In order of bound / weight the first rows are full; a row's own factor counts if the row is not full under it,
    and the largest of these is the factor sought. Parts that cannot reach the goal become full.
    """
    key = [F.col(c) for c in part] or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("__ratio").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full, open_ = F.coalesce(F.sum(bound).over(before), F.lit(0.0)), F.sum(weight).over(after)
    out = df.withColumn("__ratio", F.when(F.col(weight) > 0, F.col(bound) / F.col(weight)))
    out = out.withColumn("__factor", F.when(F.col(weight) > 0, (F.col(goal) - full) / open_))
    own = Window.partitionBy(*key)
    best = F.coalesce(F.max(F.when(F.col("__factor") <= F.col("__ratio"), F.greatest("__factor", F.lit(0.0)))).over(own), F.max("__ratio").over(own), F.lit(0.0))
    return out.withColumn(weight, F.col(weight) * best).drop("__ratio", "__factor")


def rake(cells: DataFrame, targets: dict[str, DataFrame], total: float, sweeps: int = SWEEPS) -> DataFrame:
    """Add ``weight``: tokens to take of each cell, at most those it has, that sum to ``total`` and meet the target shares.

    ``targets``: dim -> (dim, share). The cell table has at most the product of the numbers of categories as rows,
    whatever the corpus.
    """
    out, near = cells, (lambda df: df.coalesce(1)) if cells.limit(ONE_PARTITION + 1).count() <= ONE_PARTITION else (lambda df: df)
    for dim, target in targets.items():
        out = out.join(target.withColumnRenamed("share", f"__share_{dim}"), dim, "left").fillna(0.0, [f"__share_{dim}"])
    wanted = F.least(*[F.col(f"__share_{d}") for d in targets], F.lit(1.0)) > 0
    out = stored(out.withColumn("__bound", F.when(wanted, F.col("tokens").cast("double")).otherwise(0.0)), "bounds")
    total = min(total, out.agg(F.sum("__bound")).first()[0] or 0.0)
    if not total:
        return out.withColumn("weight", F.lit(0.0)).drop("__bound", *[f"__share_{d}" for d in targets])
    for dim in targets:
        goals = out.groupBy(dim).agg(F.sum("__bound").alias("__all"), F.max(f"__share_{dim}").alias("__share"))
        goals = goals.withColumn("__goal", F.col("__share")).withColumn("__total", F.lit(total))
        goals = filled(goals.where("__all > 0"), [], "__goal", "__all", "__total")
        goals = goals.withColumn("__even", F.col("__share") / F.sum("__share").over(Window.partitionBy(F.lit(0))) * total)
        goals = stored(goals.select(dim, F.least("__goal", "__all").alias(f"__goal_{dim}"), "__even"), "bounded-goals")
        short = goals.where(F.col("__even") - F.col(f"__goal_{dim}") > TOLERANCE * total)
        if n := short.count():
            some = [f"{r[0]!r}: {r[1] / total:.4f} of {r[2] / total:.4f}" for r in short.orderBy(F.col("__even").desc(), dim).limit(20).collect()]
            warnings.warn(f"{n} targets of {dim} exceed all tokens of their category, which is taken whole: {', '.join(some)}", stacklevel=2)
        out = out.join(goals.drop("__even"), dim, "left").fillna(0.0, [f"__goal_{dim}"])
    out = stored(out.withColumn("weight", F.col("__bound")), "bounded")
    take, errors = F.least("weight", "__bound"), []
    off = F.greatest(*[F.abs(F.sum(take).over(Window.partitionBy(d)) - F.col(f"__goal_{d}")) for d in targets], F.lit(0.0))
    while True:
        out = near(out)
        for _ in range(STEP):
            for dim in targets:
                out = filled(out, [dim], "weight", "__bound", f"__goal_{dim}")
        out = stored(out, "bounded")
        errors.append(near(out).select(off.alias("e")).agg(F.max("e")).first()[0] / total)
        if len(errors) * STEP < sweeps:
            continue
        if errors[-1] <= TOLERANCE:
            break
        if len(errors) > PATIENCE // STEP and errors[-1] > errors[-1 - PATIENCE // STEP] / 2:
            warnings.warn(f"no sample found that meets all targets: a marginal is {errors[-1]:.6f} of the sample off", stacklevel=2)
            break
    return out.withColumn("weight", take).drop("__bound", *[f"__{x}_{d}" for d in targets for x in ("share", "goal")])


def mix(docs: DataFrame, dims: dict[str, Column], targets: dict[str, DataFrame] | float = ALPHA, budget: float = BUDGET,
        sweeps: int = SWEEPS, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, the dimensions, tokens, p (inclusion probability) and sampled.

    ``targets`` has the wanted shares by dimension, or the exponent that flattens the present ones; ``sweeps`` is the
    least number of sweeps.
    """
    names = list(dims)
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(d) for d, c in dims.items()],
                              F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("tokens")), "mix-rows")
    cells = stored(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "cells")
    if not isinstance(targets, dict):
        targets = {d: tempered(cells, d, targets) for d in names}
    tokens, n = cells.agg(F.sum("tokens"), F.sum("docs")).first()
    raked = rake(cells, targets, budget * (tokens or 0), sweeps)
    p = F.col("weight") / F.col("tokens")
    key = F.to_json(F.array(*names))
    odds = stored(raked.select(
        key.alias("__cell"), "docs", F.when(F.col("tokens") > 0, F.round(p, 9)).otherwise(0.0).alias("p")), "odds")
    rows = rows.withColumn("__cell", key)
    side = small(odds)
    if side is not odds:
        out = rows.join(side.drop("docs"), "__cell", "left")
    else:
        out = join_counted(rows, odds, "__cell", "docs", n or 0)
    p = F.coalesce("p", F.lit(0.0))
    return out.select("doc_id", *names, "tokens", p.alias("p"), (uniform(F.col("doc_id"), seed) < p).alias("sampled"))


def topic(text: Column) -> Column:
    """A coarse topic by signs of the text."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("icense") | t.contains("ights reserved"), "legal").when(t.rlike("[0-9]{3}"), "records")
            .when(t.contains("!!") | t.contains("###") | t.contains(" | "), "markup").otherwise("prose"))


def dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}


def take_mix(docs: DataFrame, dims: dict[str, Column], **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    told = mix(docs, dims, **options)
    taken = stored(told.where("sampled").select(F.col("doc_id").alias("__id")).distinct(), "taken")
    return docs.join(small(taken), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), dimensions())


def filled_sql(src: str, part: str, weight: str, bound: str, goal: str) -> str:
    """DuckDB SQL of ``filled``."""
    order = f"({part} order by ratio nulls last rows between"
    return f"""select * exclude (ratio, factor) replace ({weight} * coalesce(max(case when factor <= ratio then greatest(factor, 0) end)
    over ({part}), max(ratio) over ({part}), 0) as {weight})
  from (select *, case when {weight} > 0 then ({goal} - coalesce(sum({bound}) over {order} unbounded preceding and 1 preceding), 0))
      / sum({weight}) over {order} current row and unbounded following) end factor
    from (select *, case when {weight} > 0 then {bound} / {weight} end ratio from ({src})))"""


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of ``op1_mixing`` over a table or subquery."""
    dims = ("source", "lang", "topic")
    goals = ",\n".join(
        f"goal_{d} as materialized (select {d}, least(goal, most) goal_{d} from ("
        + filled_sql(f"select {d}, sum(bound) most, any_value(share_{d}) goal, any_value(total) total from bounds group by {d} having sum(bound) > 0",
                     "", "goal", "most", "total") + "))" for d in dims)
    sweep = "select * from sweeps where not done"
    for d in dims:
        sweep = filled_sql(sweep, f"partition by {d}", "weight", "bound", f"goal_{d}")
    off = ", ".join(f"abs(sum(least(weight, bound)) over (partition by {d}) - goal_{d})" for d in dims)
    back = PATIENCE // STEP
    return f"""
with recursive d as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang,
  case when contains(t, 'icense') or contains(t, 'ights reserved') then 'legal' when regexp_matches(t, '[0-9]{{3}}') then 'records'
    when contains(t, '!!') or contains(t, '###') or contains(t, ' | ') then 'markup' else 'prose' end topic,
  len(regexp_extract_all(t, '{WORD}'))::bigint tokens from (select *, coalesce(text, '') t from {docs})),
cells as materialized (select source, lang, topic, sum(tokens)::bigint tokens from d group by all),
{', '.join(f"share_{d} as (select {d}, pow(sum(tokens), {ALPHA}) share_{d} from cells group by {d})" for d in dims)},
bounds as materialized (select * exclude (wanted), {BUDGET} * sum(tokens) over () total
  from (select *, least({', '.join(f'share_{d}' for d in dims)}, 1) > 0 wanted, case when wanted then tokens::double else 0 end bound
    from cells {' '.join(f'join share_{d} using ({d})' for d in dims)})),
{goals},
sweeps as (
  select source, lang, topic, tokens, bound, total, {', '.join(f'coalesce(goal_{d}, 0) goal_{d}' for d in dims)}, bound weight, 0 k,
    []::double[] errors, false done from bounds {' '.join(f'left join goal_{d} using ({d})' for d in dims)}
  union all
  select * exclude (e1, e) replace (k + 1 as k, case when k % {STEP} = {STEP - 1} then list_append(errors, e) else errors end as errors,
    k % {STEP} = {STEP - 1} and k + 1 >= {SWEEPS} and (e <= {TOLERANCE} or (len(errors) >= {back} and e > errors[len(errors) - {back - 1}] / 2)) as done)
  from (select *, max(e1) over () / total e from (select *, greatest({off}) e1 from ({sweep}))) ),
odds as (select source, lang, topic, case when tokens > 0 then round(least(weight, bound) / tokens, 9) else 0.0 end p from sweeps where done)
select doc_id, source, lang, topic, tokens, p::double p,
  cast('0x' || substr(md5(concat('42:', doc_id)), 1, 13) as bigint) / 4503599627370496.0 < p sampled
from d join odds using (source, lang, topic)"""


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": oracle()}
