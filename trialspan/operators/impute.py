"""Imputation and scaling fitted on training rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import any_null
from ..functions.sizing import attach_one, cut
from .clean import drop_null_rows
from .neighbours import (_CHUNK, _ROWS, _TILE_ROWS, _WIDE, GROUPS, QUERY_BLOCK, REF_BLOCK, Lists, fold_copies, knn_join, meet, nearest_lists,
                         query_groups)

# The imputation phases of the configuration.
PHASES = ("none", "pre_feature", "post_feature_remove_rows", "post_feature_knn")
_FEW = 64  # donors of a batch whose exact distances bound those of a query's nearest


def _train(df: DataFrame, train_flag: str | None) -> DataFrame:
    return df.where(F.col(train_flag) == 1) if train_flag else df


def fill_mean(df: DataFrame, cols: Sequence[str], train_flag: str | None = None) -> DataFrame:
    """Fill NULLs with the means of the training rows."""
    means = _train(df, train_flag).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    return (attach_one(df, means)
            .select(*[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in set(cols) else F.col(c)
                      for c in df.columns]))


def knn_impute(df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, train_flag: str | None = None,
               **blocks) -> DataFrame:
    """A missing cell becomes the mean of the k nearest training rows' mean-filled values.

    Distances use the mean-filled matrix. Training rows do not see themselves. Only rows with a
    missing cell are queries.
    """
    means = _train(df, train_flag).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    base = attach_one(df, means)
    filled = base.select(F.col(id_col).alias("id"),
                         (F.col(train_flag) if train_flag else F.lit(1)).alias("__t"), any_null(list(cols)).alias("__q"),
                         F.array(*[F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(0.0)).cast("double") for c in cols])
                         .alias("v"))
    filled = cut(filled)
    refs = filled.where("__t = 1").select("id", "v")
    near = knn_join(filled.where("__q").select("id", "v"), refs, k, skip_self=True, **blocks)
    values = (near.join(refs.select(F.col("id").alias("rid"), F.col("v").alias("rv")), "rid")
              .groupBy(F.col("id").alias(id_col)).agg(*[F.avg(F.get("rv", i)).alias(f"__k_{c}")
                                                        for i, c in enumerate(cols)]))
    out = df.join(values, id_col, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__k_{c}")).alias(c) if c in set(cols) else F.col(c)
                        for c in df.columns])


def missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols])


def _shared_distances(qv: np.ndarray, rv: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Distance over the coordinates that both rows of a pair have, times d / their number; infinite without any."""
    d, out = qv.shape[1], np.empty(len(qi))
    step = max(1, _CHUNK // (4 * d))
    for s in range(0, len(qi), step):
        diff = qv[qi[s:s + step]] - rv[ri[s:s + step]]
        both = ~np.isnan(diff)
        n = both.sum(1)
        dist = np.sqrt(np.where(both, diff * diff, 0.0).sum(1) * d / np.maximum(n, 1))
        out[s:s + step] = np.where(n > 0, dist, np.inf)
    return out


class Donors:
    """Nearest donors of every missing cell of a group of queries, distance over shared coordinates; donors come in batches.

    One masked product around a centre, in single precision, gives the unscaled squares of all pairs, with a bound of its error. Lists
    of earlier batches, or else the exact distances of the few that are least in a part of the batch, bound those of the k
    nearest donors of each cell; only pairs that can be within are computed exactly. Cells of columns that too few of them hold are
    compared with all donors. Where single precision excludes little, double precision does it again.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int) -> None:
        holes = np.isnan(v)
        self.ids, self.v, self.k, self.holes, self.left = ids, v, k, holes, None
        self.row, self.dim = np.nonzero(holes)
        self.count = holes.sum(1)
        self.first = np.r_[0, np.cumsum(self.count)]
        self.has = np.maximum(v.shape[1] - self.count, 1)  # no pair shares more coordinates
        self.lists, self.off = Lists(len(self.row), k), 4.8e-7 * (3 * v.shape[1] + 8)

    def _product(self, s: int, e: int, r0: np.ndarray, held: np.ndarray, right: np.ndarray | None) -> np.ndarray:
        """Squares over shared coordinates of a tile of queries with a batch, lowered by what the products may be off."""
        if right is not None:
            return self.left[s:e] @ right
        return self._left(s, e, 1e-12) @ self._right(r0, held, 1e-12)

    def _left(self, s: int, e: int, off: float) -> np.ndarray:
        q0 = self.q0[s:e]
        return np.hstack([q0 * q0 * (1 - off), -2.0 * q0, ~self.holes[s:e]])

    def _right(self, r0: np.ndarray, held: np.ndarray, off: float) -> np.ndarray:
        return np.hstack([held, r0, r0 * r0 * (1 - off)]).T

    def add(self, v: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        held, full = ~np.isnan(v), np.isfinite(self.lists.bound).all()
        if self.left is None:
            some = np.sort(v[:1024], axis=0)  # NaN comes last
            middle = np.take_along_axis(some, np.maximum(held[:1024].sum(0) - 1, 0)[None] // 2, 0)[0]
            self.centre = np.where(np.isfinite(middle), middle, 0.0)
            self.q0 = np.where(self.holes, 0.0, self.v - self.centre)
            self.left = self._left(0, len(self.v), self.off).astype("float32") if (self.q0 ** 2).sum(1).max(initial=0) < _WIDE else self.q0
        r0 = np.where(held, v - self.centre, 0.0)
        plain = (r0 * r0).sum(1).max(initial=0) < _WIDE and self.left is not self.q0
        right = self._right(r0, held, self.off).astype("float32") if plain else None
        skip, step = max(1, min(4, len(v) // (4 * _FEW))), max(1, min(_TILE_ROWS, _CHUNK // len(v)))
        for s in range(0, len(self.v), step):
            e = min(s + step, len(self.v))
            self._tile(s, e, v, held, ids, self._product(s, e, r0, held, right), skip,
                       (lambda s=s, e=e: self._product(s, e, r0, held, None)) if right is not None else None)
        if not full:
            self.lists.merge()

    def _tile(self, s: int, e: int, v: np.ndarray, held: np.ndarray, ids: np.ndarray, squares: np.ndarray, skip: int, again) -> None:
        d, qv, begin, end = v.shape[1], self.v[s:e], self.first[s], self.first[e]
        row, dim = self.row[begin:end] - s, self.dim[begin:end]
        kth = self.lists.bound[begin:end].copy()
        open_ = ~np.isfinite(kth)
        if open_.any():
            some = np.unique(row[open_])
            few = squares[some][:, ::skip]
            m = min(_FEW, few.shape[1])
            near = np.argpartition(few, m - 1, axis=1)[:, :m] * skip
            told = _shared_distances(qv, v, np.repeat(some, m), near.ravel()).reshape(len(some), m)
            if m >= self.k:
                at = np.searchsorted(some, row[open_])
                kth[open_] = np.partition(np.where(held[near[at], dim[open_, None]], told[at], np.inf), self.k - 1, axis=1)[:, self.k - 1]
        sure, bar = np.isfinite(kth), np.full(e - s, -1.0)
        np.maximum.at(bar, row[sure], kth[sure])
        limit = np.where(bar < 0, -np.inf, bar * bar * self.has[s:e] / d * (1 + 1e-9))
        mask = squares <= np.minimum(limit * (1 + 1e-6), 1e37)[:, None].astype(squares.dtype)
        if again is not None and mask.size > _ROWS and np.count_nonzero(mask) > mask.size // 16:
            mask = again() <= limit[:, None]
        qi, ri = np.divmod(np.flatnonzero(mask), len(v))
        dist = _shared_distances(qv, v, qi, ri)
        good = dist <= bar[qi]
        qi, ri, dist = qi[good], ri[good], dist[good]
        # every cell of the query that the donor holds
        n = self.count[s:e][qi]
        cell = np.repeat(self.first[s:e][qi] - begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        ri, dist = np.repeat(ri, n), np.repeat(dist, n)
        good = held[ri, dim[cell]] & sure[cell] & (dist <= kth[cell])
        cell, ri, dist = cell[good], ri[good], dist[good]
        self.lists.add(begin + cell, dist, ids[ri], v[ri, dim[cell]])
        for i in np.unique(dim[~sure]):
            rest, donors = np.nonzero(~sure & (dim == i))[0], np.nonzero(held[:, i])[0]
            if len(donors):
                x, y = np.repeat(rest, len(donors)), np.tile(donors, len(rest))
                z = _shared_distances(qv, v, row[x], y)
                good = np.isfinite(z)
                self.lists.add(begin + x[good], z[good], ids[y[good]], v[y[good], i])

    def found(self) -> tuple[pa.Array, ...]:
        cells, begin, near = self.lists.found()
        return (pa.array(self.ids[self.row[cells]]), pa.array(self.dim[cells].astype("int64")),
                pa.ListArray.from_arrays(pa.array(begin, pa.int32()), near))


def _donor_block(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """Nearest donors of every missing cell of some rows among some others."""
    stack = lambda x: np.stack(x["v"].to_numpy()).astype("float64")
    none = pd.DataFrame({"id": [], "dim": [], "rid": [], "dist": [], "value": []}).astype({"id": "int64", "dim": "int64", "rid": "int64"})
    if not len(q) or not len(r):
        return none
    search = Donors(q["id"].to_numpy(), stack(q), k)
    search.add(stack(r), np.ones(len(r), dtype="int64"), r["id"].to_numpy())
    ids, dim, near = search.found()
    n, x = near.value_lengths().to_numpy(), near.flatten()
    return pd.DataFrame({"id": np.repeat(ids.to_numpy(), n), "dim": np.repeat(dim.to_numpy(), n),
                         **{c: x.field(c).to_numpy() for c in ("rid", "dist", "value")}})


def knn_impute_shared(df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, scaled: bool = False,
                      ref_block: int = REF_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """kNN imputation with the distance over coordinates present in both rows.

    Times d / shared coordinates. That is no metric, so nothing can be pruned: all rows pass each hashed query
    group in batches, and of each missing cell the k nearest rows that hold the value stay. Cells without any donor get the column mean. With ``scaled`` columns count by their own deviation.
    """
    nan = F.lit(float("nan"))
    means = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    if scaled:
        unit = {c: F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in cols}
        base, value = attach_one(df, means), (lambda c: (F.col(c).cast("double") - F.col(f"__m_{c}")) / unit[c])
        back = lambda c: F.col(f"__k_{c}") * unit[c] + F.col(f"__m_{c}")
    else:
        base, value, back = df, (lambda c: F.col(c).cast("double")), (lambda c: F.col(f"__k_{c}"))
    packed = cut(base.select(F.col(id_col).alias("id"), any_null(list(cols)).alias("__q"), F.array(*[
        F.coalesce(value(c), nan) for c in cols]).alias("v")))
    # copies: the k + 1 smallest ids stand for all, and equal rows share one search
    refs = cut(fold_copies(packed.select("id", "v"), k + 1).select(F.explode("ids").alias("id"), "v"))
    asked = packed.where("__q").select("id", "v")
    rows = cut(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    n_grp = query_groups(rows.count(), query_block)
    n_blk = max(1, min(-(-refs.count() // ref_block), -(-GROUPS // n_grp)))
    left = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_grp)).alias("g"),
                       F.explode(F.expr(f"sequence(0L, {n_blk - 1}L)")).alias("blk"))
    right = refs.select("id", F.array("id").alias("ids"), "v", F.pmod(F.xxhash64("id"), F.lit(n_blk)).alias("blk"),
                        F.explode(F.expr(f"sequence(0L, {n_grp - 1}L)")).alias("g"))
    found = meet(left, right, ["blk", "g"], n_blk * n_grp, lambda ids, v: Donors(ids, v, k + 1), ("id", "dim"))
    lists = nearest_lists(found, ["id", "dim"], k + 1)
    per_vector = rows.join(lists, "id").select("v", "dim", "near")
    near = F.slice(F.filter("near", lambda x: x["rid"] != F.col("id")), 1, k)
    cells = asked.join(per_vector, "v").select("id", "dim", F.try_divide(
        F.aggregate(near, F.lit(0.0), lambda acc, x: acc + x["value"]), F.size(near).cast("double")).alias("value"))
    wide = cells.groupBy(F.col("id").alias(id_col)).agg(*[
        F.max(F.when(F.col("dim") == i, F.col("value"))).alias(f"__k_{c}") for i, c in enumerate(cols)])
    out = attach_one(df.join(wide, id_col, "left"), means)
    return out.select(*[F.coalesce(F.col(c), back(c), F.col(f"__m_{c}")).alias(c) if c in set(cols)
                        else F.col(c) for c in df.columns])


def missing_tests(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, float]]:
    """Chi-square p-value (2 x 2, continuity corrected) of own against any missing, per column.

    The counts of all columns come from one aggregate row.
    """
    anyn = any_null(list(cols))
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in cols],
                 F.count_if(anyn).alias("__any"), *[F.count(F.when(anyn, F.col(c))).alias(f"__a_{c}") for c in cols]
                 ).first().asDict()
    out = []
    for c in cols:
        a, b = row[c], row["__n"] - row[c]
        p, q = row[f"__a_{c}"], row["__any"] - row[f"__a_{c}"]
        out.append((c, _chi2_p(a, b, p, q)))
    return out


def _chi2_p(a: int, b: int, c: int, d: int) -> float:
    n, r1, r2, c1, c2 = a + b + c + d, a + b, c + d, a + c, b + d
    if 0 in (r1, r2, c1, c2):
        return 1.0
    expected = [r1 * c1 / n, r1 * c2 / n, r2 * c1 / n, r2 * c2 / n]
    shift = min(0.5, abs(a - expected[0]))
    stat = sum((abs(o - e) - shift) ** 2 / e for o, e in zip((a, b, c, d), expected))
    return math.erfc(math.sqrt(stat / 2.0))


def selective_indicators(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> tuple[DataFrame, list[str]]:
    """Add missing indicators for the columns that survive Benjamini-Hochberg at ``alpha``."""
    tests = sorted(missing_tests(df, cols), key=lambda t: t[1])
    adjusted, low = {}, 1.0
    for i in range(len(tests), 0, -1):
        low = min(low, tests[i - 1][1] * len(tests) / i)
        adjusted[tests[i - 1][0]] = low
    kept = [c for c in cols if adjusted[c] < alpha]
    return missing_indicators(df, kept), kept


def impute_selective(df: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, alpha: float = 0.05,
                     scaled: bool = False) -> tuple[DataFrame, list[str]]:
    """Indicators of the columns whose missing cells are informative, then neighbours fill all missing cells."""
    marked, kept = selective_indicators(df, cols, alpha)
    return knn_impute_shared(marked, id_col, cols, k, scaled), kept


def resolve_phase(value: str | None) -> str:
    """Unknown or missing phases mean ``pre_feature``."""
    name = (value or "").strip().lower() if isinstance(value, str) else ""
    return name if name in PHASES else "pre_feature"


def impute(df: DataFrame, phase: str | None, stage: str, id_col: str, cols: Sequence[str], k: int = 5,
           train_flag: str | None = None) -> DataFrame:
    """What the configured phase does at ``stage`` (``raw`` before features, ``windows`` after)."""
    phase = resolve_phase(phase)
    if stage == "raw":
        return knn_impute(df, id_col, cols, k, train_flag) if phase == "pre_feature" else df
    if phase == "post_feature_remove_rows":
        return drop_null_rows(df, cols)
    if phase == "post_feature_knn":
        return knn_impute(df, id_col, cols, k, train_flag)
    return df


def standardize(df: DataFrame, cols: Sequence[str], train_flag: str | None = None) -> DataFrame:
    """Scale by training mean and population deviation; zero deviation divides by 1."""
    aggs = [x for c in cols for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))]
    stats = _train(df, train_flag).agg(*aggs)
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0))
              for c in cols}
    return attach_one(df, stats).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])
