"""Registry of queries: a Spark callable, an output spec and, where SQL can say it, an oracle.

The spec ``name:type`` lists the output columns. Both sides get the same final projection:
``l`` bigint, ``s`` text, ``b`` boolean, ``dN`` double kept to N places (``d`` = 6). The offset in
the rounding keeps exact decimal ties away from the rounding edge, where the last bit of a
sum would otherwise decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspan.functions.timeline import Axis, fit_block, time_axis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROUND_OFFSET = 0.381966


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(p.strip().split(":")) for p in spec.split(",")]


def _spark_col(name: str, kind: str):
    c = F.col(name)
    if kind == "l":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    scale = 10.0 ** int(kind[1:] or 6)
    return (F.floor(c.cast("double") * F.lit(scale) + F.lit(ROUND_OFFSET)).cast("double") / F.lit(scale)).alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind == "l":
        return f'cast("{name}" as bigint) as "{name}"'
    if kind == "s":
        return f'cast("{name}" as varchar) as "{name}"'
    if kind == "b":
        return f'cast("{name}" as boolean) as "{name}"'
    scale = 10.0 ** int(kind[1:] or 6)
    return f'floor(cast("{name}" as double) * {scale!r} + {ROUND_OFFSET!r}) / {scale!r} as "{name}"'


def _needed(text: str) -> list[str]:
    """Shared views used by ``text``, directly or through each other, in declaration order."""
    found, todo = set(), [text]
    while todo:
        t = todo.pop()
        for c in CTES:
            if c not in found and re.search(rf"\b{c}\b", t):
                found.add(c)
                todo.append(CTES[c])
    return [c for c in CTES if c in found]


def check(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with an optional DuckDB oracle."""
    fields = _fields(spec)

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in fields])

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip().replace(" as window", ' as "window"')
            ctes = ""
            used = _needed(body)
            if used:
                ctes = "with " + ", ".join(f"{c} as ({CTES[c]})" for c in used) + " "
            ORACLES[name] = (f"{ctes}select {', '.join(_sql_col(n, k) for n, k in fields)} "
                             f"from ({body}) as q")
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shapes derived from the given tables -------------------------------------------------

# Sizes used by all signal queries, in seconds.
WINDOW, STRIDE, EARLY, OFFSET, SHIFT = 172800, 43200, 432000, 86400, 3

CTES: dict[str, str] = {
    "signals": """
select user_id as trial_id, 1 + user_id % 13 as subject_id, event_id as sample_id,
  date_diff('second', timestamp '2024-01-01 00:00:00', ts) as t_s,
  case when event_id % 7 = 0 then null else value end as sig_a,
  case when event_id % 11 = 0 or user_id % 17 = 0 then null
       else cast(json_extract_string(props, '$.k') as double) end as sig_b,
  case when event_type = 'error' then 'onset' when event_type = 'signup' then 'recovery'
       when event_type = 'purchase' then 'marker' end as event,
  case when user_id % 4 = 0 then 1 else 0 end as afe
from events""",
    # interval label by ordinal pairing inside the trial (naive form)
    "pairs": """
select o.trial_id, o.t_s as t0, o.sample_id as s0, r.t_s as t1, r.sample_id as s1
from (select *, row_number() over (partition by trial_id order by t_s, sample_id) as k
      from signals where event = 'onset') o
join (select *, row_number() over (partition by trial_id order by t_s, sample_id) as k
      from signals where event = 'recovery') r on o.trial_id = r.trial_id and o.k = r.k""",
    "labelled": """
select s.*, case when exists (select 1 from pairs p where p.trial_id = s.trial_id
    and (s.t_s > p.t0 or (s.t_s = p.t0 and s.sample_id >= p.s0))
    and (s.t_s < p.t1 or (s.t_s = p.t1 and s.sample_id < p.s1))) then 1 else 0 end as y
from signals s""",
    "resting": "select c_custkey as subject_id, c_acctbal as resting from customer",
    # long form of the matrix
    "cells": """
select vec_id, label, i as dim, cast(embedding[i] as double) as x,
  case when substr(md5(concat('null:', cast(vec_id as varchar), ':', cast(i as varchar))), 1, 2) < '08'
       then 1 else 0 end as hole
from (select *, unnest(range(1, 65)) as i from embeddings)""",
    "preds": """
select doc_id, quality as y, toxic as p, doc_id % 10 as fold, doc_id % 3 as model,
  cast(concat('0x', substr(md5(concat('score:', cast(doc_id as varchar))), 1, 8)) as bigint) / 4294967296.0 * 0.7
    + 0.3 * quality as score
from labels""",
    "catalog": """
select distinct p_brand || ' ' || p_type || ' - ' ||
    case p_size % 4 when 0 then 'EEG' when 1 then 'Pupil' when 2 then 'Centrifuge' else 'HR belt' end
    || '_v' || cast(p_size % 9 as varchar)
    || case p_partkey % 3 when 0 then '' when 1 then '_derivative' else '_2derivative' end
    || '_' || case p_partkey % 4 when 0 then 'mean' when 1 then 'stddev' when 2 then 'max' else 'range' end
    || case p_partkey % 2 when 0 then '_s1' else '_s2' end as feature
from part""",
}


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: two sparse signals, sparse event marks and a condition flag."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as trial_id",
        "1 + user_id % 13 as subject_id",
        "event_id as sample_id",
        "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) as t_s",
        "case when event_id % 7 = 0 then null else value end as sig_a",
        "case when event_id % 11 = 0 or user_id % 17 = 0 then null "
        "else cast(get_json_object(props, '$.k') as double) end as sig_b",
        "case when event_type = 'error' then 'onset' when event_type = 'signup' then 'recovery' "
        "when event_type = 'purchase' then 'marker' end as event",
        "case when user_id % 4 = 0 then 1 else 0 end as afe",
    )


@lru_cache(maxsize=16)
def _block(app: str, sf_dir: str) -> float:
    spark = SparkSession.getActiveSession()
    return fit_block(signals(spark, sf_dir), "trial_id", "t_s", 3600.0)


def axis(spark: SparkSession, sf_dir: str) -> Axis:
    """Time axis of the signals with a block length measured once per folder."""
    return time_axis(block=_block(spark.sparkContext.applicationId, sf_dir))


def resting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_acctbal").alias("resting"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality as y", "toxic as p", "doc_id % 10 as fold", "doc_id % 3 as model",
        "conv(substr(md5(concat('score:', cast(doc_id as string))), 1, 8), 16, 10) / 4294967296.0D * 0.7D"
        " + 0.3D * quality as score")


def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat(p_brand, ' ', p_type, ' - ', case p_size % 4 when 0 then 'EEG' when 1 then 'Pupil' "
        "when 2 then 'Centrifuge' else 'HR belt' end, '_v', cast(p_size % 9 as string), "
        "case p_partkey % 3 when 0 then '' when 1 then '_derivative' else '_2derivative' end, '_', "
        "case p_partkey % 4 when 0 then 'mean' when 1 then 'stddev' when 2 then 'max' else 'range' end, "
        "case p_partkey % 2 when 0 then '_s1' else '_s2' end) as feature").distinct()


MATRIX = [f"x{i}" for i in range(1, 65)]


def matrix(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """``embeddings`` as 64 double columns, a binary label and optional hash-chosen holes."""
    cols = []
    for i in range(1, 65):
        x = f"cast(embedding[{i - 1}] as double)"
        if holes:
            x = (f"case when substr(md5(concat('null:', cast(vec_id as string), ':', '{i}')), 1, 2) < '08' "
                 f"then null else {x} end")
        cols.append(f"{x} as x{i}")
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", "case when label = 0 then 1 else 0 end as y", "vec_id % 20 as grp", *cols)
