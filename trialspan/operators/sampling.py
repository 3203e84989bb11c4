"""Folds, holdouts and resampling in a reproducible md5 order.

Ranks come from :func:`positions` over hash prefixes, so a class that holds nearly all rows is
ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_key, hash_uniform
from ..functions.sizing import attach, attach_one, cut
from ..functions.timeline import Axis, fit_digits, hash_axis, positions, sorted_axis
from .neighbours import knn_join, vectors

_H = "__h"


def hash_ranks(df: DataFrame, id_col: str, keys: Sequence[str] = (), seed: int | str = 42,
               out: str = "rank", digits: int | None = None) -> DataFrame:
    """0-based rank in md5 order inside ``keys``; blocks are hash prefixes sized by the row count."""
    hashed = df.withColumn(_H, hash_key(id_col, seed=seed))
    digits = digits or fit_digits(df.count())
    return positions(hashed, hash_axis(tuple(keys), _H, id_col, digits), out).drop(_H)


def stratified_folds(df: DataFrame, id_col: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """Row folds with equal class shares."""
    if k < 2:
        raise ValueError("need at least two folds")
    return hash_ranks(df, id_col, [y], seed, "__r").withColumn("fold", F.col("__r") % k).drop("__r")


def take_fold(df: DataFrame, fold: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold of a frame that has a ``fold`` column."""
    if not 0 <= fold < k:
        raise ValueError(f"fold {fold} is outside 0..{k - 1}")
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def group_folds(df: DataFrame, group: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """Whole groups per fold; groups with positives are dealt in snake order by positives."""
    groups = df.groupBy(group).agg(F.sum(F.col(y).cast("bigint")).alias("__p"))
    ordered = groups.select(group, (F.col("__p") > 0).alias("__has"), (-F.col("__p")).alias("__np"),
                            hash_key(group, seed=seed).alias(_H))
    ranged, axis = sorted_axis(ordered, ["__has", "__np", _H, group])
    ranked = positions(ranged, Axis(("__has",), ("__np", _H, group), axis.block), "__r")
    at, turn = F.col("__r") % k, F.floor(F.col("__r") / k) % 2
    folds = ranked.select(group, F.when(turn == 1, k - 1 - at).otherwise(at).alias("fold"))
    return attach(df, folds, [group])


def random_split(df: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """``is_test`` = 1 for exactly ceil(ratio n) rows."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    ranked = attach_one(hash_ranks(df, id_col, (), seed, "__r"), n)
    return ranked.withColumn("is_test", (F.col("__r") < F.ceil(F.lit(ratio) * F.col("__n"))).cast("int")).drop("__r", "__n")


def group_holdout(df: DataFrame, group: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Hold out whole groups (ceil of the share)."""
    held = random_split(df.select(group).distinct(), group, ratio, seed)
    return attach(df, held, [group])


def _class_sizes(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))


def undersample(df: DataFrame, id_col: str, y: str, seed: int = 42) -> DataFrame:
    """Random under-sampling of every class to the smallest class."""
    small = _class_sizes(df, y).agg(F.min("__n").alias("__min"))
    ranked = attach_one(hash_ranks(df, id_col, [y], seed, "__r"), small)
    return ranked.where("__r < __min").select(*df.columns)


def replicate(df: DataFrame, times: Column, out: str = "copy", chunk: int = 1024) -> DataFrame:
    """Repeat each row ``times`` times; long repeats are spread over tasks in chunks."""
    n = df.withColumn("__n", times.cast("bigint")).where("__n > 0")
    parts = n.withColumn("__c", F.explode(F.expr(f"sequence(0L, (__n - 1) div {chunk}L)")))
    parts = parts.repartition(F.xxhash64(*[c for c in df.columns if c != "v"][:1], "__c"))
    return parts.withColumn(out, F.explode(F.expr(
        f"sequence(__c * {chunk}L, least((__c + 1) * {chunk}L, __n) - 1)"))).drop("__n", "__c")


def drawn_rows(slots: DataFrame, ranked: DataFrame, keys: Sequence[str], size: str, seed: int | str) -> DataFrame:
    """For each slot (id ``__slot``, ``copy``, keys and class size) the row of a random rank: draws with replacement."""
    u = hash_uniform(hash_key("__slot", "copy", seed=seed))
    return slots.withColumn("__r", F.floor(u * F.col(size))).join(ranked, [*keys, "__r"])


def oversample(df: DataFrame, id_col: str, y: str, seed: int = 42, replacement: bool = False) -> DataFrame:
    """Random over-sampling of every class to the largest class; ``copy`` 0 is the row itself.

    Copies are dealt evenly over the rows of a class, or, with ``replacement``, each is a draw of its own; then ``copy``
    numbers the draws of a slot, and a row may come any number of times.
    """
    if replacement:
        sizes = cut(_class_sizes(df, y))
        ranked = cut(hash_ranks(df, id_col, [y], seed, "__r"))
        goal = sizes.agg(F.max("__n").alias("__max"))
        rest = F.col("__max") - F.col("__n")
        times = F.floor(rest / F.col("__n")) + (F.col("__r") < rest % F.col("__n")).cast("int")
        slots = attach(attach_one(ranked.select(F.col(id_col).alias("__slot"), y, "__r"), goal), sizes, [y])
        slots = slots.select("__slot", y, F.col("__n").alias("__size"), times.alias("__t"))
        slots = replicate(slots, F.col("__t")).select("__slot", y, "__size", (F.col("copy") + 1).alias("copy"))
        made = drawn_rows(slots, ranked, [y], "__size", f"{seed}:d").select(*[f"`{c}`" for c in df.columns], "copy")
        return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(made)
    sizes = _class_sizes(df, y)
    goal = sizes.agg(F.max("__n").alias("__max"))
    ranked = attach(attach_one(hash_ranks(df, id_col, [y], seed, "__r"), goal), sizes, [y])
    times = F.floor(F.col("__max") / F.col("__n")) + (F.col("__r") < F.col("__max") % F.col("__n")).cast("int")
    return replicate(ranked.select(*df.columns, times.alias("__t")), F.col("__t")).select(*df.columns, "copy")


def smote(df: DataFrame, id_col: str, y: str, cols: Sequence[str], k: int = 7, seed: int = 42,
          minority: int = 1, **blocks) -> DataFrame:
    """Synthetic minority rows x + u (neighbour - x) up to the majority size.

    Returns the original rows (``copy`` = -1) and the synthetic ones (``copy`` >= 0 counts them per
    base row). The neighbour and u come from md5, so the result is reproducible.
    """
    counts = df.agg(F.count_if(F.col(y) == minority).alias("__a"), F.count_if(F.col(y) != minority).alias("__b"))
    small = cut(df.where(F.col(y) == minority).select(id_col, *cols))
    packed = vectors(small, id_col, cols)
    near = knn_join(packed, packed, k, skip_self=True, **blocks)
    ranked = attach_one(hash_ranks(small.select(id_col), id_col, (), seed, "__r"), counts)
    new = F.greatest(F.col("__b") - F.col("__a"), F.lit(0))
    times = F.floor(new / F.col("__a")) + (F.col("__r") < new % F.col("__a")).cast("int")
    size = near.groupBy(F.col("id").alias(id_col)).agg(F.count(F.lit(1)).alias("__k"))
    seeds = replicate(ranked.select(id_col, times.alias("__t")), F.col("__t")).join(size, id_col)
    pick = F.floor(hash_uniform(hash_key(id_col, "copy", seed=f"{seed}:n")) * F.col("__k")).cast("int") + 1
    chosen = seeds.select(id_col, "copy", pick.alias("rank"),
                          hash_uniform(hash_key(id_col, "copy", seed=f"{seed}:u")).alias("__u"))
    pairs = chosen.join(near.select(F.col("id").alias(id_col), "rid", "rank"), [id_col, "rank"])
    a = small.select(id_col, *[F.col(c).alias(f"__a_{c}") for c in cols])
    b = small.select(F.col(id_col).alias("rid"), *[F.col(c).alias(f"__b_{c}") for c in cols])
    made = pairs.join(a, id_col).join(b, "rid").select(
        id_col, F.lit(minority).alias(y), F.col("copy"),
        *[(F.col(f"__a_{c}") + F.col("__u") * (F.col(f"__b_{c}") - F.col(f"__a_{c}"))).alias(c) for c in cols])
    kept = df.select(id_col, y, F.lit(-1).cast("bigint").alias("copy"), *cols)
    return kept.unionByName(made)


def weighted_sample(df: DataFrame, id_col: str, y: str, weights: dict[int, float], seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are rows, each row weighted by its class.

    A draw first picks the class by its total weight, then a rank inside it, so a draw finds its
    row by an equi-join. ``draw`` numbers the draws.
    """
    sizes = {r[y]: r["__n"] for r in _class_sizes(df, y).collect()}
    known = sorted(c for c in sizes if weights.get(c, 0) > 0)
    total = sum(weights[c] * sizes[c] for c in known)
    edges, acc = [], 0.0
    for c in known:
        acc += weights[c] * sizes[c] / total
        edges.append((c, acc))
    draws = hash_ranks(df.select(id_col), id_col, (), seed, "draw")
    u = hash_uniform(hash_key("draw", seed=f"{seed}:c"))
    cls = F.lit(edges[-1][0])
    for c, e in reversed(edges[:-1]):
        cls = F.when(u < e, F.lit(c)).otherwise(cls)
    n_of = F.create_map(*[x for c in known for x in (F.lit(c), F.lit(sizes[c]))])
    picked = draws.select("draw", cls.alias(y)).withColumn(
        "__r", F.floor(hash_uniform(hash_key("draw", seed=f"{seed}:r")) * n_of[F.col(y)]))
    return hash_ranks(df, id_col, [y], seed, "__r").join(picked, [y, "__r"]).select("draw", *df.columns)
