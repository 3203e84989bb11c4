"""Quality classification by co-training a text view and a metadata view.

Each view has its own logistic regression: the text view sees hashed words and the shape of the text, the
metadata view its source, language and recorded length. In each round both are fitted, calibrated on held-out
labels, and label the unlabelled documents they are sure of for the other view. In the end the calibrated views
are combined by a third regression on the held-out labels, and all documents are scored in one pass.

The fit runs on a bounded sample: at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, chosen by a
hash of their id. Scoring reads every whole text.

Defined cases: a null text is empty; null metadata is a value of its own; labels that are null or whose document
is missing are ignored; if a class has no label in the sample, nothing can be told apart and every document has
the score 1 (kept); repeated rows each get a row; other columns of the documents pass through ``keep`` only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stored
from .hashing import U, Words
from .mixing import uniform
from .pieces import slices

LABELLED, POOL = 8_000, 8_000
ROUNDS = 3
SURE = 0.98  # calibrated probability of a pseudo-label
WORDS = 256  # hashed words
META = 96  # hashed metadata
CHARS = 300_000  # bytes of text at a time
_KIND = np.full(256, 7, dtype=np.int64)  # byte kinds: 0 space, 1 lower, 2 upper, 3 digit, 4 sentence signs, 5 other signs, 6 line feed, 7 beyond ASCII
_KIND[:128] = 5
for _chars, _kind in ((b" \t\r\x0b\x0c", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3), (b".,;:?'\"()-", 4), (b"\n", 6)):
    _KIND[list(_chars)] = _kind


def text_view(texts: list[str | None]) -> np.ndarray:
    """(texts, features): shape of each text and its hashed words."""
    w, n = Words(texts), len(texts)
    owner = np.repeat(np.arange(n), w.size + 1)
    kinds = np.bincount(owner * 8 + _KIND[w.data], minlength=8 * n).reshape(n, 8).astype(float)
    kinds[:, 6] -= 1  # the line feed between texts
    count = np.bincount(w.text, minlength=n).astype(float)
    order = np.lexsort((w.hash, w.text))
    h, t = w.hash[order], w.text[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.append(head, len(h)))
    most, distinct = np.zeros(n), np.bincount(t[head], minlength=n).astype(float)
    np.maximum.at(most, t[head], runs)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.text, length, n) / np.maximum(count, 1)
    size = np.maximum(w.size, 1.0)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    shape = np.column_stack([kinds / size[:, None], kinds[:, 2] / letters, distinct / np.maximum(count, 1), most / np.maximum(count, 1),
                             mean, np.log1p(count), np.log1p(kinds[:, 6]), count / (kinds[:, 6] + 1), kinds[:, 5] / np.maximum(count, 1),
                             np.sqrt(distinct / np.maximum(count, 1)), count == 0])
    shape[:, 14] = np.log1p(shape[:, 14])
    bag = np.bincount(w.text * WORDS + (w.hash & U(WORDS - 1)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    return np.hstack([shape, np.sqrt(bag / np.maximum(count, 1)[:, None])])


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """(documents, META): one-hot hashes of source, language, their pair, and steps of the recorded length."""
    out = np.zeros((len(source), META))
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        step = -1 if c is None else int(c).bit_length()
        for f in (f"source {s}", f"lang {g}", f"step {step}", f"{g} {step}"):
            out[i, zlib.crc32(f.encode()) % META] += 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Regression:
    """Logistic regression on standardised features, fitted by Newton steps with a squared penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> Regression:
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, keep = np.zeros(a.shape[1]), np.full(a.shape[1], penalty)
        keep[-1] = 1e-6
        for _ in range(steps):
            p = sigmoid(a @ w)
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
            w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale), -8, 8) @ self.weight[:-1] + self.weight[-1]


@dataclass
class CoTrained:
    """Both views with their calibration, and what combines them; no views if there was nothing to learn."""

    text: Regression | None = None
    meta: Regression | None = None
    text_scale: Regression | None = None
    meta_scale: Regression | None = None
    both: Regression | None = None
    accuracy: float = float("nan")

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: combined, text view, metadata view."""
        if self.both is None:
            one = np.ones(len(text))
            return one, one, one
        t = self.text_scale.logit(self.text.logit(text)[:, None])
        m = self.meta_scale.logit(self.meta.logit(meta)[:, None])
        return sigmoid(self.both.logit(np.column_stack([t, m]))), sigmoid(t), sigmoid(m)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """``label``: 0, 1 or -1 (unlabelled); ``held``: labelled rows used for calibration only."""
    fit, held = (label >= 0) & ~held, (label >= 0) & held
    if len(np.unique(label[fit])) < 2 or len(np.unique(label[held])) < 2:
        return CoTrained()
    known = [label.copy(), label.copy()]  # what each view learns from
    for y in known:
        y[held] = -1
    views, models, scales = (text, meta), [None, None], [None, None]
    for step in range(rounds + 1):
        for k in (0, 1):
            use = known[k] >= 0
            models[k] = Regression.fit(views[k][use], known[k][use])
            scales[k] = Regression.fit(models[k].logit(views[k][held])[:, None], label[held])
        if step < rounds:
            for k in (0, 1):
                p = sigmoid(scales[k].logit(models[k].logit(views[k])[:, None]))
                free = (label < 0) & (np.maximum(p, 1 - p) >= sure)
                known[1 - k][free] = (p[free] > 0.5).astype(int)
    z = np.column_stack([scales[k].logit(models[k].logit(views[k][held])[:, None]) for k in (0, 1)])
    both = Regression.fit(z, label[held])
    return CoTrained(*models, *scales, both, float(((both.logit(z) > 0) == label[held]).mean()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          meta: tuple[str, str, str] = ("source", "lang", "n_chars"), labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Fit on at most ``labelled`` labelled and ``pool`` unlabelled documents."""
    share = lambda n, rows: min(1.0, 0.9 * n / max(1, rows))
    u = uniform(F.col("__id"), 7)
    told = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    told = stored(told.where(u < share(labelled, labels.count())).groupBy("__id").agg(F.max("__y").alias("__y")).limit(labelled), "labels")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), *[F.col(c).cast("string" if i < 2 else "long").alias(f"__m{i}")
                                                                                  for i, c in enumerate(meta)])
    rows = rows.join(F.broadcast(told), "__id", "left").where(F.col("__y").isNotNull() | (u < share(pool, docs.count())))

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m0, m1, m2, y, held = (batch.column(i).to_pylist() for i in range(1, 6))
            for a, b, t in slices(batch.column(0), CHARS):
                x = np.hstack([text_view(t), meta_view(m0[a:b], m1[a:b], m2[a:b])]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y[a:b], pa.int32()),
                                                  pa.array(held[a:b], pa.bool_())], names=["x", "y", "held"])

    held = F.pmod(F.xxhash64("__id"), F.lit(3)) == 0
    got = rows.select("__t", "__m0", "__m1", "__m2", "__y", held.alias("held")).mapInArrow(view, "x binary, y int, held boolean")
    got = got.limit(2 * (labelled + pool)).collect()  # the bound, also if ids repeat
    if not got:
        return CoTrained()
    got.sort(key=lambda r: bytes(r.x))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    y = np.array([-1 if r.y is None else r.y for r in got])
    return co_train(x[:, :-META], x[:, -META:], y, np.array([bool(r.held) for r in got]))


def score(docs: DataFrame, model: CoTrained, text_col: str = "text", meta: tuple[str, str, str] = ("source", "lang", "n_chars"),
          keep: tuple[str, ...] = ("doc_id",), at_least: float | None = None) -> DataFrame:
    """Columns ``keep`` of every row with score, text_score and meta_score; with ``at_least``, only the columns of
    the rows that reach it."""
    small_batches(docs.sparkSession)
    n, kept = len(keep), [f"`{c}`" for c in keep]
    out = docs.select(*kept).schema
    if at_least is None:
        out = out.add("score", "double").add("text_score", "double").add("meta_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m0, m1, m2 = (batch.column(n + i).to_pylist() for i in range(1, 4))
            for a, b, t in slices(batch.column(n), CHARS):
                p = model.score(text_view(t), meta_view(m0[a:b], m1[a:b], m2[a:b]))
                cols = [batch.column(i).slice(a, b - a) for i in range(n)]
                if at_least is None:
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.float64()) for x in p]], names=out.names)
                else:
                    good = pa.array(p[0] >= at_least)
                    yield pa.RecordBatch.from_arrays([c.filter(good) for c in cols], names=out.names)

    return docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(kept)], F.col(text_col).alias("__t"), *[F.col(c).cast("string" if i < 2 else "long").alias(f"__m{i}")
                                                            for i, c in enumerate(meta)]).mapInArrow(run, out)


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels"))).withColumn("keep", F.col("score") >= 0.5)


QUERIES = {"op3_co_training": op3_co_training}
ORACLES: dict[str, str] = {}
