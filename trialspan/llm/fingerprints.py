"""Document fingerprints as invertible Bloom lookup tables.

A text is cut into paragraphs: at line breaks and, so that long lines are not one unit, after words whose hash
ends in ``CUT`` zero bits (a content-defined cut, the same wherever the words occur). The digests of the
paragraphs, numbered where one repeats, are added to a table of cells (count, sum of digests, sum of checks),
three cells each. The difference of two tables holds only what the texts do not share; cells with one digest
left are peeled until the table is empty, which recovers every digest that differs. If peeling gets stuck, both
tables are built again ``GROW`` times larger. The likeness of two texts is the share of paragraphs in common.
All tables of a batch lie in flat arrays and are peeled at the same time.

The next document is found without one sorted partition: ids are cut into ranges of about equal row counts,
each range also receives the first row of the next range, and the rows of a range are streamed in order.

Defined cases: a null text is empty; an empty text has an empty table, equal only to empty ones; words count,
not the white space between them; rows that repeat an id follow one another, ordered by text; a null id comes
first; a single row is its own next document; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .hashing import U, Words, mix, stream

CUT = 3  # a paragraph is cut after one word in 2 ** CUT
CELLS = 15  # of the table that is the fingerprint
GROW = 4
CHARS = 300_000  # of a slice
_SEED = stream(9, 64) | U(1)
_SET = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])


class Sets:
    """The paragraph digests of some texts: flat, with the text number of each."""

    def __init__(self, texts: list[str]):
        w = Words(texts)
        n = len(w.hash)
        self.texts = len(texts)
        if not n:
            self.digest, self.text, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
            return
        with np.errstate(over="ignore"):
            lines = np.concatenate([[0], np.cumsum(w.data == 10)])
            new_line = np.concatenate([[True], lines[w.start[1:]] != lines[w.end[:-1]]])
            cut = np.concatenate([[True], (w.hash[:-1] & U((1 << CUT) - 1)) == 0])
            head = np.flatnonzero(new_line | cut | np.concatenate([[True], w.text[1:] != w.text[:-1]]))
            place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
            digest = mix(np.add.reduceat(mix(w.hash + place.astype(U) * _SEED[0]), head))
            text = w.text[head]
            order = np.lexsort((digest, text))
            digest, text = digest[order], text[order]
            first = np.concatenate([[True], (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])])
            nth = np.arange(len(digest)) - np.maximum.accumulate(np.where(first, np.arange(len(digest)), 0))
            self.digest, self.text = mix(digest + nth.astype(U) * _SEED[1]), text
        self.size = np.bincount(text, minlength=len(texts))

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of some texts, and the place in ``which`` of each."""
        first = np.concatenate([[0], np.cumsum(self.size)])
        size = self.size[which]
        at = np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.digest[at], np.repeat(np.arange(len(which)), size)


def cells_of(digest: np.ndarray, text: np.ndarray, cells: int) -> np.ndarray:
    """(3, digests) cell numbers; each text has ``cells`` cells in three equal parts."""
    part = cells // 3
    with np.errstate(over="ignore"):
        return np.stack([text * cells + j * part + (mix(digest * _SEED[3 + j] + U(cells)) % U(part)).astype(np.int64)
                         for j in range(3)])


def check_of(digest: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(digest * _SEED[2]) >> U(32)


def table(digest: np.ndarray, text: np.ndarray, texts: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum of digests, sum of checks of all cells of all texts."""
    count, total, check = np.zeros(texts * cells, np.int64), np.zeros(texts * cells, U), np.zeros(texts * cells, U)
    with np.errstate(over="ignore"):
        for at in cells_of(digest, text, cells):
            np.add.at(count, at, 1)
            np.add.at(total, at, digest)
            np.add.at(check, at, check_of(digest))
    return count, total, check


def peel(a: tuple, b: tuple, texts: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Differences of two sets of tables: digests, their text, +1 / -1 for a's / b's own, and which texts came out empty."""
    out: list[tuple] = []
    with np.errstate(over="ignore"):
        count, total, check = (x - y for x, y in zip(a, b, strict=True))
        look = np.arange(texts * cells)
        while len(look):
            sign = count[look]
            digest = np.where(sign == 1, total[look], U(0) - total[look])
            seen = np.where(sign == 1, check[look], U(0) - check[look])
            pure = (np.abs(sign) == 1) & (check_of(digest) == seen)
            digest, sign, text = digest[pure], sign[pure], look[pure] // cells
            if not len(digest):
                break
            order = np.lexsort((digest, text))  # a digest alone in several cells is taken once
            digest, sign, text = digest[order], sign[order], text[order]
            once = np.concatenate([[True], (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])])
            digest, sign, text = digest[once], sign[once], text[once]
            out.append((digest, text, sign))
            at = cells_of(digest, text, cells)
            for row in at:
                np.subtract.at(count, row, sign)
                np.subtract.at(total, row, np.where(sign == 1, digest, U(0) - digest))
                np.subtract.at(check, row, np.where(sign == 1, check_of(digest), U(0) - check_of(digest)))
            look = np.unique(at)
    clean = ((count == 0) & (total == 0) & (check == 0)).reshape(texts, cells).all(axis=1)
    digest, text, sign = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return digest, text, sign, clean


def differences(a: Sets, b: Sets, pairs_a: np.ndarray, pairs_b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of digests that only a's, only b's text of each pair has; larger tables until all pairs are peeled."""
    own = np.zeros((2, len(pairs_a)), np.int64)
    left = np.arange(len(pairs_a))
    while len(left):
        da, ta = a.of(pairs_a[left])
        db, tb = b.of(pairs_b[left])
        _, text, sign, clean = peel(table(da, ta, len(left), cells), table(db, tb, len(left), cells), len(left), cells)
        for k, s in enumerate((1, -1)):
            got = np.bincount(text[sign == s], minlength=len(left))
            own[k, left[clean]] = got[clean]
        left, cells = left[~clean], cells * GROW
    return own[0], own[1]


def likeness(a: Sets, b: Sets, pairs_a: np.ndarray, pairs_b: np.ndarray) -> np.ndarray:
    """Paragraphs in common over all paragraphs; two empty texts are alike."""
    only_a, only_b = differences(a, b, pairs_a, pairs_b)
    every = a.size[pairs_a] + only_b
    return np.where(every > 0, (a.size[pairs_a] - only_a) / np.maximum(every, 1), 1.0)


def written(s: Sets) -> list[str]:
    """Fingerprints as text: the cells of each table, base64."""
    count, total, check = table(s.digest, s.text, s.texts, CELLS)
    rows = np.zeros(len(count), _SET)
    rows["count"], rows["digest"], rows["check"] = count, total, (check & U(0xFFFFFFFF)).astype(np.uint32)
    raw, step = rows.tobytes(), CELLS * _SET.itemsize
    return [base64.b64encode(raw[i * step:(i + 1) * step]).decode() for i in range(s.texts)]


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(texts: list[str], following: list[str]) -> dict[str, list]:
    """Columns of the comparison of each text with its edit and with the following text."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    own, new, nxt = Sets(texts), Sets(changed), Sets(following)
    i = np.arange(len(texts))
    return {"n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": written(own), "edited_fingerprint": written(new),
            "near_edited": likeness(own, new, i, i), "near_next": likeness(own, nxt, i, i)}


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows (range, extra, id, text): each range in order, then an extra copy of the first row of the next one."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keys, n = docs.select(key.alias("key")), 4 * parts
    cuts = keys.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)], 10 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [0], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), side="left").astype("int32"))

    heads = (keys.select(range_of("key").alias("range"), "key").groupBy("range").agg(F.min("key").alias("key"))
             .orderBy("range").collect())  # a row per range
    before = {h["key"]: heads[i - 1]["range"] for i, h in enumerate(heads)}  # the first range follows the last

    @F.pandas_udf("array<int>")
    def ranges(x: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, x.to_numpy(), side="left").tolist()
        return pd.Series([[r, before[k]] if k in before else [r] for r, k in zip(own, x.tolist(), strict=True)])

    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (rows.select(F.posexplode(ranges("key")).alias("extra", "range"), "key", "id", "text").repartition(parts, "range")
            .sortWithinPartitions("range", "extra", "key", F.col("id").asc_nulls_first(), "text").drop("key"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text, following text)
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            cols = fingerprint([h[1] for h in held], [h[2] for h in held])
            return pa.RecordBatch.from_arrays([
                pa.array([h[0] for h in held], pa.int64()), pa.array(cols["n_chars"], pa.int64()),
                *[pa.array(cols[c], pa.string()) for c in names[1:4]], *[pa.array(cols[c], pa.float64()) for c in names[4:]]],
                names=["doc_id", *names])

        for batch in batches:
            texts = (x.as_py() for x in batch.column(3))  # one at a time
            for extra, r, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), texts, strict=True):
                if last is not None and last[0] == r:
                    held.append((last[1], last[2], text))
                    size += len(last[2]) + len(text)
                last = None if extra else (r, i, text)
                if size > CHARS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return with_next(docs, id_col, text_col, parts).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def op9_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op9_iblt": op9_iblt}
ORACLES: dict[str, str] = {}
