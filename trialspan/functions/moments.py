"""Counts, means and scatter matrices of many columns by fold, from one pass over the rows.

Tasks add up blocks of rows as matrix products around their own means and merge them, so nothing cancels; what travels is
one matrix a task and fold, then one a merging task. Every training set of a cross-validation is a difference of such
moments, so a search over penalties and folds does not read the data again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGERS = 8  # tasks that merge what the others send
_SCHEMA = "key long, n long, mean array<double>, scatter array<double>"


@dataclass(frozen=True)
class Moments:
    """Rows, column means and the sum of outer products of deviations from them."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        c = x - mean
        return Moments(len(x), mean, c.T @ c)

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))

    def __sub__(self, part: Moments) -> Moments:
        """What is left without a part that was added."""
        n = self.n - part.n
        if not n or not part.n:
            return self if n else Moments(0, np.zeros_like(self.mean), np.zeros_like(self.scatter))
        mean = self.mean + (self.mean - part.mean) * (part.n / n)
        apart = part.mean - mean
        return Moments(n, mean, self.scatter - part.scatter - np.outer(apart, apart) * (n * part.n / self.n))

    def covariance(self, sample: bool = True) -> np.ndarray:
        return self.scatter / max(1, self.n - 1 if sample else self.n)


def _rows(parts: Iterable[tuple[int, Moments]]) -> pa.RecordBatch:
    parts = list(parts)
    as_lists = lambda f: pa.array([f(m).ravel().tolist() for _, m in parts], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()), pa.array([m.n for _, m in parts], pa.int64()),
                                       as_lists(lambda m: m.mean), as_lists(lambda m: m.scatter)], names=["key", "n", "mean", "scatter"])


def moments_by(df: DataFrame, cols: Sequence[str], key: str | None = None) -> dict[int, Moments]:
    """Moments of the columns for every value of an integer column (0 if none is given); a missing value is an error."""
    d, names = len(cols), list(cols)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(d)]).astype("float64")
            if np.isnan(x).any():
                raise ValueError(f"missing values in {names[int(np.isnan(x).any(axis=0).argmax())]}")
            k = batch.column(0).to_numpy(zero_copy_only=False)
            for v in np.unique(k).tolist():
                m = Moments.of(x[k == v])
                found[v] = found[v] + m if v in found else m
        yield _rows(found.items())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for r in batch.to_pylist():
                m = Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(d, d))
                found[r["key"]] = found[r["key"]] + m if r["key"] in found else m
        yield _rows(found.items())

    rows = df.select((F.col(key).cast("long") if key else F.lit(0).cast("long")).alias("__key"),
                     *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])
    if rows.where(F.col("__key").isNull()).limit(1).count() if key else False:
        raise ValueError(f"missing values in {key}")
    sent = rows.mapInArrow(partial, _SCHEMA).repartition(MERGERS).mapInArrow(merge, _SCHEMA)
    out: dict[int, Moments] = {}
    for r in sent.collect():
        m = Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(d, d))
        out[r["key"]] = out[r["key"]] + m if r["key"] in out else m
    return out


def together(parts: Iterable[Moments], d: int) -> Moments:
    return reduce(Moments.__add__, parts, Moments(0, np.zeros(d), np.zeros((d, d))))
