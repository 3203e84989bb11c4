"""K-nearest-neighbour join: exact by pivots and blocks, or approximate by a hashed bucket index.

Exact copies are folded first: of each distinct reference vector only the k smallest ids can ever
be among the k nearest (ties go by id), and equal queries share one search. The distinct
references are assigned to their nearest pivot. From the pivots' radii and their k closest rows
every query gets an upper bound of its k-th distance, and visits only cells whose ball can hold
something nearer (triangle inequality, so no neighbour is lost). Where a few queries show that this
excludes too little to be worth a copy of the query for each cell, all references are one cell. Large cells are split into
blocks and crowded blocks get several query groups, so one task sees a bounded number of rows on
both sides; the references pass the queries of a task in batches, distances live in NumPy blocks
inside the task and only the k best per query are emitted.

The approximate mode replaces cells by buckets: a few bits per vector, one for each direction. A query probes the buckets
that it is nearest to; how many is measured on the data for a wanted recall, not assumed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_key
from ..functions.sizing import attach, cut

PIVOTS = 4  # fewest; otherwise a quarter of the root of the distinct references
REF_BLOCK = 50_000
QUERY_BLOCK = 5_000  # fewest rows of a query group where there are more; GROUPS groups may have as many, then they grow fourfold
GROUPS = 24
VISIT_COST = 1000  # distances that cost as much as one more copy of a query and its neighbours
BUCKET_ROWS = 64  # fewest references that a bucket should hold; otherwise the root of their number
FIT_ROWS = 4096  # references that directions and thresholds are fitted on
FIT_QUERIES = 256  # queries whose exact neighbours size the probing
PROBES = 32  # most buckets a query visits: each takes a copy of it and gives a list
FLIPS = 12  # most bits in which a probed bucket may differ
_CHUNK = 4_000_000  # distance entries held at once
_TILE = 64, 2048  # rows and columns of absolute differences that stay in the processor's cache
_ROWS = 16_384  # vectors that a task emits at once
_REFS_AT_ONCE = 8192  # fewest references, unless the group ends, that a group of queries meets at once
_TILE_ROWS = 256  # queries of one product
_WIDE = 1e30  # squares from which single precision is not tried
_NONE = np.iinfo("int64").max  # id of an empty place


def vectors(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(id, v) with the columns packed into an array of doubles."""
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """All distances between the rows of two small blocks."""
    out = np.empty((len(a), len(b)))
    if p == 1:
        up, across = _TILE
        left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        for s in range(0, len(a), up):
            for t in range(0, len(b), across):
                total = np.zeros((len(a[s:s + up]), len(b[t:t + across])))
                diff = np.empty_like(total)
                for x, y in zip(left[:, s:s + up], right[:, t:t + across]):
                    np.subtract(x[:, None], y, out=diff)
                    total += np.abs(diff, out=diff)
                out[s:s + up, t:t + across] = total
        return out
    step = max(1, _CHUNK // max(1, b.size))
    for s in range(0, len(a), step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.sqrt((diff * diff).sum(2))
    return out


def upper_kth(rough: np.ndarray, k: int, part: int = 16) -> np.ndarray:
    """A bound (column) of the k-th smallest entry of every row, read off one in ``part`` columns; infinite with fewer."""
    few = rough[:, ::max(1, min(part, rough.shape[1] // (4 * k)))]
    return np.partition(few, k - 1, axis=1)[:, k - 1:k] if few.shape[1] > k else np.full((len(rough), 1), np.inf)


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype("float64")


def _exact(a: np.ndarray, b: np.ndarray, qi: np.ndarray, ri: np.ndarray, p: int) -> np.ndarray:
    """Distances of some pairs of rows."""
    exact = np.empty(len(qi))
    step = max(1, _CHUNK // a.shape[1])
    for s in range(0, len(qi), step):
        diff = a[qi[s:s + step]] - b[ri[s:s + step]]
        exact[s:s + step] = np.abs(diff).sum(1) if p == 1 else np.sqrt((diff * diff).sum(1))
    return exact


def _within(a: np.ndarray, b: np.ndarray, k: int, p: int, bound: np.ndarray | None = None) -> np.ndarray:
    """Mask of the pairs that surely contain the k nearest of every row of ``a``, or all within its ``bound`` (column)."""
    if p == 1:
        rough, less = distances(a, b, 1), 0.0
        slack = (1e-12 * (np.abs(a).sum(1) + np.abs(b).sum(1).max()))[:, None]
    else:
        # squared distance less the square of the row of a, from one product
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        rough, less = np.c_[-2.0 * a, np.ones(len(a))] @ np.c_[b, b2].T, a2[:, None]
        slack = (1e-9 * (a2 + b2.max()))[:, None]
    limit = upper_kth(rough, k)
    if bound is not None:
        limit = np.minimum(limit, bound - less if p == 1 else bound * bound - less)
    return rough <= limit + slack


def _candidates(a: np.ndarray, b: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs and exact distances that surely contain the k nearest of every row of ``a``."""
    qi, ri = np.nonzero(_within(a, b, k, p))
    return qi, ri, _exact(a, b, qi, ri, p)


def first_of_runs(group: np.ndarray, k: int) -> np.ndarray:
    """Mask of the first k entries of every run of a sorted array."""
    start = np.r_[0, np.nonzero(np.diff(group))[0] + 1]
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


class Lists:
    """The k nearest (distance, id; ties by id) that each of n rows has met, with a value that comes along."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.dist, self.rid, self.value = k, np.full((n, k), np.inf), np.full((n, k), _NONE), np.zeros((n, k))
        self.new, self.waiting = [], 0

    @property
    def bound(self) -> np.ndarray:
        return self.dist[:, -1]

    def add(self, row: np.ndarray, dist: np.ndarray, rid: np.ndarray, value: np.ndarray) -> None:
        """Rows may wait, unsorted, until there are as many as the lists have."""
        self.new.append((row, dist, rid, value))
        self.waiting += len(row)
        if self.waiting > max(self.dist.size, _ROWS):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        row, dist, rid, value = (np.concatenate(x) for x in zip(*self.new))
        self.new, self.waiting = [], 0
        hit = np.unique(row)
        row, dist = np.r_[row, np.repeat(hit, self.k)], np.r_[dist, self.dist[hit].ravel()]
        rid, value = np.r_[rid, self.rid[hit].ravel()], np.r_[value, self.value[hit].ravel()]
        order = np.lexsort((rid, dist, row))
        order = order[first_of_runs(row[order], self.k)]  # k of each, as the old ones are among them
        for own, x in ((self.dist, dist), (self.rid, rid), (self.value, value)):
            own[hit] = x[order].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        """Rows with entries, where the entries of each begin, and all entries."""
        self.merge()
        real = self.rid != _NONE
        rows = np.nonzero(real.any(1))[0]
        entries = pa.StructArray.from_arrays([pa.array(x[real]) for x in (self.dist, self.rid, self.value)], names=["dist", "rid", "value"])
        return rows, np.r_[0, np.cumsum(real.sum(1)[rows])], entries


class Search:
    """The k nearest of references that come in batches, for the queries of one group.

    A cheap distance of all pairs, with a bound of its error, tells which can be among the k nearest seen so far; these are
    computed exactly. Squared distances come from a product of single precision around a centre. Sums of absolute differences come
    from whole numbers of 16 bits, twice the sum of the larger coordinate less both sums, whose wrap-around cancels; what
    rounding did to each row is known. Where that excludes little, double precision does it again.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, p: int) -> None:
        self.ids, self.v, self.k, self.p, self.lists, self.void, self.centre = ids, v, k, p, Lists(len(v), k), False, None
        self.plain = bool(np.isfinite(v).all())

    def add(self, v: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.void |= bool(np.isnan(v).any())  # a reference without a distance: no list
        if self.void or not len(self.v):
            return
        plain = self.plain and bool(np.isfinite(v).all())
        rough = (self._sums(v) if self.p == 1 else self._squares(v)) if plain else None
        begin, full = np.cumsum(lens) - lens, np.isfinite(self.lists.bound).all()
        step = max(1, min(_TILE_ROWS, _CHUNK // len(v)))
        for s in range(0, len(self.v), step):
            a, bound = self.v[s:s + step], self.lists.bound[s:s + step, None]
            mask = rough(s, s + step, bound) if rough else None
            if mask is None or mask.size > _ROWS and np.count_nonzero(mask) > mask.size // 16:
                mask = _within(a, v, self.k, self.p, bound) if plain else ~np.isnan(a).any(1)[:, None] & np.ones(len(v), dtype=bool)
            qi, ri = np.divmod(np.flatnonzero(mask), len(v))
            d = _exact(a, v, qi, ri, self.p)
            near = d <= bound[qi, 0]
            qi, ri, d = qi[near], ri[near], d[near]
            if len(ids) != len(lens):  # one entry per copy of the vector
                n = lens[ri]
                at = np.repeat(begin[ri] - np.cumsum(n) + n, n) + np.arange(n.sum())
                qi, d, ri = np.repeat(qi, n), np.repeat(d, n), at
            self.lists.add(s + qi, d, ids[ri], np.zeros(len(qi)))
        if not full:
            self.lists.merge()

    def _squares(self, b: np.ndarray):
        if self.centre is None:
            self.centre = np.median(b[:1024], axis=0)
            a = self.v - self.centre
            self.a2 = (a * a).sum(1)[:, None]
            self.left = np.c_[-2.0 * a, np.ones(len(a))].astype("float32") if self.a2.max() < _WIDE else None
        b = b - self.centre
        b2 = (b * b).sum(1)
        if self.left is None or b2.max() >= _WIDE:
            return None
        # the square of a reference is lowered by what its products may be off
        rounding = 1.2e-7 * (b.shape[1] + 8)
        right = np.ascontiguousarray(np.c_[b, b2 * (1 - 2 * rounding)].T, dtype="float32")
        slack, back = rounding * self.a2, (4 * rounding * b2).astype("float32")

        def mask(s: int, e: int, bound: np.ndarray) -> np.ndarray:
            rough = self.left[s:e] @ right
            limit, off = np.minimum(bound * bound, 1e37) - self.a2[s:e], slack[s:e]
            open_ = ~np.isfinite(bound[:, 0])
            if open_.any():
                limit[open_] = np.minimum(upper_kth(rough[open_] + back, self.k, 4).astype("float64"), 1e37) + off[open_]
            return rough <= (limit + off + 1e-6 * np.abs(limit)).astype("float32")

        return mask

    def _sums(self, b: np.ndarray):
        lo, hi = np.minimum(self.v.min(0), b.min(0)), np.maximum(self.v.max(0), b.max(0))
        levels = 65_535 - b.shape[1]
        unit = float((hi - lo).sum()) / levels or 1.0
        if levels < 16 * b.shape[1] or not np.isfinite(unit):
            return None

        def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = np.rint((x - lo) / unit)
            off = np.abs(x - lo - n * unit).sum(1) + 1e-12 * (np.abs(x).sum(1) + np.abs(lo).sum())
            n = n.astype("uint16")
            return np.ascontiguousarray(n.T), n.sum(1, dtype="uint16"), off

        (left, left_sum, left_off), (right, right_sum, right_off) = whole(self.v), whole(b)
        widest = right_off.max()

        def mask(s: int, e: int, bound: np.ndarray) -> np.ndarray:
            total = np.empty((len(bound), b.shape[0]), dtype="uint16")
            up, across = _TILE
            for i in range(0, len(bound), up):
                for j in range(0, b.shape[0], across):
                    x, y = left[:, s + i:s + min(i + up, len(bound))], right[:, j:j + across]
                    part, most = np.zeros((x.shape[1], y.shape[1]), dtype="uint16"), np.empty((x.shape[1], y.shape[1]), dtype="uint16")
                    for u, w in zip(x, y):
                        np.add(part, np.maximum(u[:, None], w, out=most), out=part)
                    part += part
                    part -= right_sum[j:j + across]
                    part -= left_sum[s + i:s + min(i + up, len(bound)), None]
                    total[i:i + up, j:j + across] = part
            off = (left_off[s:e, None] + widest) / unit
            limit = bound / unit + off
            open_ = ~np.isfinite(bound[:, 0])
            if open_.any():
                limit[open_] = upper_kth(total[open_].astype("float32"), self.k, 4) + 2 * off[open_]
            return total <= np.minimum(np.floor(limit * (1 + 1e-9)) + 1, 65_535).astype("uint16")

        return mask

    def found(self) -> tuple[pa.Array, ...]:
        rows, begin, near = self.lists.found()
        if self.void:
            rows, begin = rows[:0], begin[:1]
        return pa.array(self.ids[rows]), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), near)


def packed(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays of doubles as a matrix; NaN for NULL."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype("float64", copy=False)


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], groups: int, made: Callable[[np.ndarray, np.ndarray], object],
         names: Sequence[str] = ("id",)) -> DataFrame:
    """(names, near): a list of the nearest for each that the queries (id, v) of a group find among the references (id, ids, v) with the same keys.

    The references of a group pass its queries in batches, so a task holds its queries, their lists and one batch, however many
    references there are. ``made`` gets ids and vectors of the queries; its ``add`` gets vectors, numbers of copies and ids.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, refs, search = None, [], [], None

        def flush() -> None:
            nonlocal search, refs
            if queries and refs:
                if search is None:
                    ids, v = zip(*[(b.column(n + 1), b.column(n + 3)) for b in queries])
                    search = made(np.concatenate([x.to_numpy(zero_copy_only=False) for x in ids]), np.concatenate([packed(x) for x in v]))
                ids = [b.column(n + 2) for b in refs]
                search.add(np.concatenate([packed(b.column(n + 3)) for b in refs]),
                           np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in ids]).astype("int64"),
                           np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in ids]))
            refs = []

        def ended() -> Iterator[pa.RecordBatch]:
            flush()
            if search is not None:
                out = search.found()
                for s in range(0, len(out[0]), _ROWS):
                    yield pa.RecordBatch.from_arrays([x.slice(s, _ROWS) for x in out], names=[*names, "near"])

        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 1)], axis=1)
            at = np.r_[0, np.nonzero((np.diff(marks, axis=0) != 0).any(1))[0] + 1, len(marks)]
            for s, e in zip(at[:-1], at[1:]):
                if s == e:
                    continue
                if now is None or (marks[s, :n] != now).any():
                    yield from ended()
                    now, queries, refs, search = marks[s, :n], [], [], None
                (refs if marks[s, n] else queries).append(batch.slice(s, e - s))
                if sum(map(len, refs)) >= _REFS_AT_ONCE:
                    flush()
        yield from ended()

    key = [F.col(c).cast("long").alias(c) for c in keys]
    both = left.select(*key, F.lit(0).cast("long").alias("side"), "id", F.lit(None).cast("array<long>").alias("ids"), "v").unionByName(
        right.select(*key, F.lit(1).cast("long").alias("side"), "id", "ids", "v")).where("id is not null")
    return both.repartition(max(1, min(4 * groups, 2000)), *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, ", ".join(f"{c} long" for c in names) + f", near {NEAR}")


NEAR = "array<struct<dist: double, rid: long, value: double>>"


def nearest_lists(found: DataFrame, by: Sequence[str], need: int) -> DataFrame:
    """One list of the ``need`` nearest for each query, put together from those of its groups."""
    return found.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, need).alias("near"))


def fold_copies(refs: DataFrame, need: int) -> DataFrame:
    """Distinct vectors with their ``need`` smallest ids; (id, ids, v), ``id`` is the smallest.

    A group of copies is ranked in salted parts first, so no task sees all of a large one.
    """
    part = Window.partitionBy("v", "salt").orderBy("id")
    few = (refs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
           .withColumn("r", F.row_number().over(part)).where(F.col("r") <= need)
           .withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= need))
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(
        F.get("ids", 0).alias("id"), "ids", "v")


def choose_pivots(refs: DataFrame, n: int) -> np.ndarray:
    """A few reference rows picked by hash order (a bounded top-n)."""
    rows = refs.orderBy(hash_key("id", seed="pivot"), "id").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype="float64")


def _assign(refs: DataFrame, pivots: np.ndarray, p: int) -> DataFrame:
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(_stack(b["v"]), pivots, p)
                cell = d.argmin(1)
                yield b.assign(cell=cell.astype("int32"), pd=d[np.arange(len(b)), cell])
    return refs.mapInPandas(fn, "id long, ids array<long>, v array<double>, cell int, pd double")


def query_groups(n: int, query_block: int) -> int:
    """Number of query groups: ``query_block`` queries each, up to four times as many where more than ``GROUPS`` would come."""
    return max(1, -(-n // (4 * query_block)), min(-(-n // query_block), GROUPS))


def _one_cell(folded: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.withColumn("cell", F.lit(0).cast("long")) for df in (folded, asked))


def _pivot_cells(folded: DataFrame, asked: DataFrame, n: int, need: int, p: int, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """References with their cell, and the cells that each query has to visit so that no neighbour is lost.

    Without ``pivots``, all references stay one cell if the visits of ``FIT_QUERIES`` queries would cost more.
    """
    pv = choose_pivots(folded, pivots or max(int(n ** 0.5 / 4), PIVOTS))
    celled = cut(_assign(folded, pv, p))
    # per cell: radius and the distances of the rows closest to the pivot
    sized = celled.groupBy("cell").agg(F.max("pd").alias("rad"), F.count(F.lit(1)).alias("n")).collect()
    radii, sizes = {r["cell"]: r["rad"] for r in sized}, {r["cell"]: r["n"] for r in sized}
    salted = Window.partitionBy("cell", "salt").orderBy("pd")
    inner = (celled.select("cell", "pd", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt"))
             .withColumn("r", F.row_number().over(salted)).where(F.col("r") <= need))
    close = (inner.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("pd")))
             .where(F.col("r") <= need).select("cell", "pd").collect())
    near_cell = np.array([r["cell"] for r in close])
    near_pd = np.array([r["pd"] for r in close])
    cells = np.array(sorted(radii))
    radius = np.array([radii[c] for c in cells])

    def reached(v: np.ndarray) -> np.ndarray:
        d = distances(v, pv, p)
        reach = d[:, near_cell] + near_pd[None, :]
        m = min(need, reach.shape[1])
        bound = np.partition(reach, m - 1, axis=1)[:, m - 1] if reach.shape[1] >= need else np.full(len(v), np.inf)
        slack = 1e-9 * (1.0 + np.abs(d).max(1))
        return (d[:, cells] - radius[None, :]) <= (bound + slack)[:, None]

    if pivots is None:
        few = asked.orderBy(hash_key("id", seed="visits"), "id").limit(FIT_QUERIES).collect()
        go = reached(np.array([r["v"] for r in few], dtype="float64")) if few else np.zeros((1, len(cells)), dtype=bool)
        if VISIT_COST * go.sum(1).mean() + (go @ np.array([sizes[c] for c in cells])).mean() > n:
            return _one_cell(folded, asked)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, _ROWS // len(cells))
        for b in batches:
            for s in range(0, len(b), step):
                part = b.iloc[s:s + step]
                qi, ci = np.nonzero(reached(_stack(part["v"])))
                yield pd.DataFrame({"id": part["id"].to_numpy()[qi], "v": part["v"].to_numpy()[qi],
                                    "cell": cells[ci].astype("int64")})

    return celled.select("id", "ids", "v", F.col("cell").cast("long").alias("cell")), asked.mapInPandas(
        visit, "id long, v array<double>, cell long")


@dataclass(frozen=True)
class Buckets:
    """Hash of a vector: one bit per direction, set above the threshold; queries go to their ``probes`` best buckets."""

    directions: np.ndarray
    thresholds: np.ndarray
    probes: int
    recall: float

    def margins(self, v: np.ndarray) -> np.ndarray:
        return v @ self.directions - self.thresholds

    def code(self, margins: np.ndarray) -> np.ndarray:
        return ((margins > 0) << np.arange(margins.shape[1], dtype=np.int64)).sum(1)

    def ranked(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket codes in the order in which a query would visit them, and their scores (squared margins of flipped bits)."""
        w = min(margins.shape[1], FLIPS)
        weak = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :w]
        flips = (np.arange(1 << w)[:, None] >> np.arange(w)[None, :]) & 1
        score = np.take_along_axis(margins * margins, weak, 1) @ flips.T.astype("float64")
        order = np.argsort(score, axis=1, kind="stable")
        codes = self.code(margins)[:, None] ^ ((np.int64(1) << weak) @ flips.T)
        return np.take_along_axis(codes, order, 1), np.take_along_axis(score, order, 1)


def _nearest_of_few(few: list, refs: DataFrame, need: int, p: int) -> DataFrame:
    """(q, rid, dist, v) of the exact nearest references of a few collected queries, in one pass over the references."""
    ids, qv = np.array([r["id"] for r in few]), np.array([r["v"] for r in few], dtype="float64")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                qi, ri, d = _candidates(qv, _stack(b["v"]), need, p)
                order = np.lexsort((b["id"].to_numpy()[ri], d, qi))
                order = order[first_of_runs(qi[order], need)]
                yield pd.DataFrame({"q": ids[qi[order]], "rid": b["id"].to_numpy()[ri[order]], "dist": d[order],
                                    "v": b["v"].to_numpy()[ri[order]]})

    found = refs.select("id", "v").mapInPandas(scan, "q long, rid long, dist double, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "rid"))
    return found.withColumn("r", rank).where(F.col("r") <= need).drop("r")


def fit_buckets(refs: DataFrame, queries: DataFrame, n: int, need: int, p: int, recall: float) -> Buckets:
    """Directions, thresholds and number of probes for ``n`` references.

    Directions are the leading components of ``FIT_ROWS`` references and thresholds their medians, one bit for each
    halving down to ``BUCKET_ROWS`` or the root of n. The exact neighbours of ``FIT_QUERIES`` queries among all references tell how many
    probes find the share ``recall`` of them; bits are given up until that takes at most ``PROBES``. All references are
    indexed; without bits the join is exact.
    """
    pick = lambda df, m: df.orderBy(hash_key("id", seed="buckets"), "id").limit(m).collect()
    x = np.array([r["v"] for r in pick(refs, FIT_ROWS)], dtype="float64")
    bits = min(x.shape[1], max(0, math.ceil(math.log2(n / max(BUCKET_ROWS, n ** 0.5)))))
    _, vectors_ = np.linalg.eigh(np.atleast_2d(np.cov(x.T)) if len(x) > 1 else np.eye(x.shape[1]))
    w = vectors_[:, ::-1][:, :bits]
    few = pick(queries, FIT_QUERIES)
    if not bits or not few:
        return Buckets(w[:, :0], np.zeros(0), 1, 1.0)
    told = _nearest_of_few(few, refs, need, p).collect()
    at = {r["id"]: i for i, r in enumerate(few)}
    who, near = np.array([at[r["q"]] for r in told]), np.array([r["v"] for r in told], dtype="float64")
    qv = np.array([r["v"] for r in few], dtype="float64")
    for m in range(bits, 0, -1):
        b = Buckets(w[:, :m], np.median(x @ w[:, :m], axis=0), 1, 1.0)
        codes, _ = b.ranked(b.margins(qv))
        hit = codes[who] == b.code(b.margins(near))[:, None]
        probe = np.sort(np.where(hit.any(1), hit.argmax(1) + 1, codes.shape[1] + 1))
        probes = int(probe[math.ceil(recall * len(probe)) - 1])
        if probes <= min(PROBES, codes.shape[1]):
            return Buckets(b.directions, b.thresholds, probes, float((probe <= probes).mean()))
    return Buckets(w[:, :0], np.zeros(0), 1, 1.0)


def _bucket_cells(folded: DataFrame, asked: DataFrame, b: Buckets) -> tuple[DataFrame, DataFrame]:
    """References with their bucket, and the buckets that each query probes."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.assign(cell=b.code(b.margins(_stack(x["v"]))))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            step = min(256, max(1, _ROWS // b.probes))
            for s in range(0, len(x), step):
                part = x.iloc[s:s + step]
                codes = b.ranked(b.margins(_stack(part["v"])))[0][:, :b.probes]
                i = np.repeat(np.arange(len(part)), codes.shape[1])
                yield pd.DataFrame({"id": part["id"].to_numpy()[i], "v": part["v"].to_numpy()[i], "cell": codes.ravel()})

    return (folded.mapInPandas(assign, "id long, ids array<long>, v array<double>, cell long"),
            asked.mapInPandas(probe, "id long, v array<double>, cell long"))


def knn_join(queries: DataFrame, refs: DataFrame, k: int, p: int = 2, skip_self: bool = False,
             pivots: int | None = None, ref_block: int = REF_BLOCK, query_block: int = QUERY_BLOCK,
             mode: str = "exact", recall: float = 0.95) -> DataFrame:
    """(id, rid, dist, rank) for the k nearest references of every query; both sides are (id, v).

    ``skip_self`` leaves out the reference with the query's own id. Ties break by id. ``mode`` is "exact", or "approx":
    queries then visit only the buckets of a hashed index in which they expect the share ``recall`` of their neighbours.
    A few references need no cells.
    """
    if mode not in ("exact", "approx"):
        raise ValueError(f"unknown mode: {mode}")
    need = k + 1 if skip_self else k
    folded = cut(fold_copies(refs, need))
    asked = queries.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")
    n = folded.count()
    if not n:
        return queries.select("id", F.lit(None).cast("bigint").alias("rid"), F.lit(None).cast("double").alias("dist"),
                              F.lit(None).cast("int").alias("rank")).where(F.lit(False))
    asked = cut(asked)
    if mode == "approx":
        celled, visits = _bucket_cells(folded, asked, fit_buckets(folded, asked, n, need, p, recall))
    elif n <= ref_block and pivots is None:
        celled, visits = _one_cell(folded, asked)
    else:
        celled, visits = _pivot_cells(folded, asked, n, need, p, pivots)
    # blocks and query groups of the cells that are visited at all; blocks only where the groups are few
    asks = F.count(F.lit(1))
    groups = F.greatest(F.ceil(asks / (4 * query_block)), F.least(F.ceil(asks / query_block), F.lit(GROUPS).cast("long")))  # as query_groups
    plan = (visits.groupBy("cell").agg(groups.alias("n_grp"))
            .join(celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ref_block).alias("n_blk")), "cell"))
    plan = cut(plan.select("cell", "n_grp", F.least("n_blk", F.ceil(F.lit(GROUPS) / F.col("n_grp"))).alias("n_blk")))
    left = attach(visits, plan, ["cell"], "inner").select(
        F.col("id").alias("id"), F.col("v").alias("v"), "cell", F.pmod(F.xxhash64("id"), "n_grp").alias("g"), F.explode(F.expr("sequence(0L, n_blk - 1)")).alias("blk"))
    right = attach(celled, plan, ["cell"], "inner").select(
        F.col("id").alias("id"), "ids", F.col("v").alias("v"), "cell", F.pmod(F.hash("id").cast("long"), "n_blk").alias("blk"), F.explode(F.expr("sequence(0L, n_grp - 1)")).alias("g"))
    n_groups = plan.agg(F.sum(F.col("n_grp") * F.col("n_blk"))).first()[0] or 1
    found = meet(left, right, ["cell", "blk", "g"], n_groups, lambda ids, v: Search(ids, v, need, p))
    lists = nearest_lists(found, ["id"], need)
    # back to every query with that vector
    per_vector = asked.join(lists, "id").select("v", "near")
    near = F.filter("near", lambda x: x["rid"] != F.col("id")) if skip_self else F.col("near")
    return (queries.join(per_vector, "v").select("id", F.posexplode(F.slice(near, 1, k)).alias("rank", "x"))
            .select("id", F.col("x.rid").alias("rid"), F.col("x.dist").alias("dist"),
                    (F.col("rank") + 1).alias("rank")))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries with an exact neighbour, and the share of exact (id, rid) pairs that were found."""
    hit = exact.select("id", "rid").join(found.select("id", "rid", F.lit(1).alias("hit")), ["id", "rid"], "left")
    return hit.agg(F.count_distinct("id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def knn_classify(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], y: str, k: int,
                 weights: str = "uniform", p: int = 2) -> DataFrame:
    """kNN vote: share of class 1 among the neighbours and the decided class (ties go to 0)."""
    near = knn_join(vectors(test, id_col, cols), vectors(train, id_col, cols), k, p)
    labels = train.select(F.col(id_col).alias("rid"), F.col(y).cast("double").alias("__y"))
    voted = near.join(labels, "rid")
    if weights == "distance":
        # an exact hit outweighs everything else
        zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(Window.partitionBy("id"))
        w = F.when(F.col("__z") == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.nullif(F.col("dist"), F.lit(0.0)))
        voted = voted.withColumn("__z", zero).withColumn("__w", w)
    else:
        voted = voted.withColumn("__w", F.lit(1.0))
    score = F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")
    out = voted.groupBy("id").agg(score.alias("score"))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))
