"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

A slice of texts is cut into pre-tokens with array operations on the classes of its code points (the boundary
rules of the vocabulary's splitting pattern), and each distinct pre-token is counted once. The bytes of all new
pre-tokens lie in one flat array beside the number of their sequence. A round finds the lowest pair rank of every
sequence, merges that pair wherever it occurs in the sequence (from the left where occurrences overlap), for all
sequences at the same time, and compacts the arrays, until no pair is left; what remains is counted. All
occurrences may merge in one round because every merge is younger than both its parts, which is checked on the
vocabulary. A pre-token of over ``LONG`` bytes goes through the same rounds on a linked array whose places are
filed by rank, so that a round touches only the places it merges.

Defined cases: a null or empty text has no tokens and no bytes; a special token inside a text counts as one token,
as the library takes it by default; texts of any length are counted whole; repeated rows and null ids each get a
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches
from .pieces import slices

LONG = 1024  # bytes of a pre-token
SLICE = 400_000  # bytes of texts, or code points of one text, that are cut at a time
WORDS = 200_000  # distinct pre-tokens a task remembers
KEPT = 48  # code points of a pre-token that is remembered
NONE = np.int64(1) << 40
OTHER, LETTER, NUMBER, SPACE = range(4)


def byte_names() -> list[str]:
    """The characters that stand for bytes 0 to 255 in such vocabularies: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a tokenizer file: sorted pair keys with their ranks, code point classes, special strings."""

    keys: np.ndarray  # left * n + right of symbols; bytes are 0..255, the product of merge k is 256 + k
    ranks: np.ndarray
    n: int
    edges: np.ndarray  # first code point of each run of equal classes
    kinds: np.ndarray
    special: tuple[str, ...]
    name: str


def code_point_classes(pre_tokenizer) -> np.ndarray:
    """Class of every code point as the library's splitting pattern has it.

    Letters, numbers and spaces are those of the ``regex`` module, except those that the library, which may know an
    older Unicode version, does not join to a letter or a digit.
    """
    import regex
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    kind, every = np.zeros(0x110000, dtype=np.uint8), points.tobytes().decode("utf-32-le")
    for value, pattern, before in ((LETTER, r"\p{L}", "a"), (NUMBER, r"\p{N}", "1"), (SPACE, r"\s", "")):
        chars = regex.findall(pattern, every)
        if before:
            starts = {a for _, (a, _) in pre_tokenizer.pre_tokenize_str("".join(f"{before}{c}\n\n" for c in chars))}
            chars = [c for i, c in enumerate(chars) if 4 * i + 1 not in starts]
        kind[np.frombuffer("".join(chars).encode("utf-32-le"), dtype=np.uint32)] = value
    return kind


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the ``tokenizers`` library; raises ValueError if its rules are not those here."""
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        text = f.read()
    d = json.loads(text)
    model, pre = d["model"], d["pre_tokenizer"] or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
             "ignore_merges": False}
    if (model["type"] != "BPE" or any((model.get(k) or v) != v for k, v in plain.items()) or d["normalizer"]
            or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        raise ValueError("not a plain byte-level BPE vocabulary")
    if any(t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("a special token that takes in what is around it")
    symbol = {c: b for b, c in enumerate(byte_names())}
    if not symbol.keys() <= model["vocab"].keys():
        raise ValueError("a byte is not in the vocabulary")
    pairs, n = {}, 256 + len(model["merges"])
    for k, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        if a not in symbol or b not in symbol or a + b in symbol:
            raise ValueError("a merge before its parts, or two merges with one product")
        pairs[symbol[a] * n + symbol[b]] = k
        symbol[a + b] = 256 + k
    keys = np.array(sorted(pairs), dtype=np.int64)
    kind = code_point_classes(Tokenizer.from_str(text).pre_tokenizer)
    edges = np.flatnonzero(np.diff(kind, prepend=255))
    return Vocabulary(np.append(keys, np.iinfo(np.int64).max), np.array([pairs[k] for k in keys] + [0], dtype=np.int64),
                      n, edges, kind[edges], tuple(t["content"] for t in d["added_tokens"]),
                      hashlib.sha256(text.encode()).hexdigest())


def every_other(follows: np.ndarray) -> np.ndarray:
    """The first, third, fifth... of each run of overlapping places; ``follows`` tells whether a place overlaps the one before."""
    k = np.arange(len(follows))
    return (k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0


class Counter:
    """Counts tokens of texts under one vocabulary; remembers the counts of short pre-tokens."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.kind = np.repeat(v.kinds, np.diff(np.append(v.edges, 0x110000)))
        self.special = re.compile("|".join(map(re.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None
        self.seen: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pair that two symbols make, NONE if none."""
        key = left * self.v.n + right
        k = np.searchsorted(self.v.keys, key)
        return np.where(self.v.keys[k] == key, self.v.ranks[k], NONE)

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where a pre-token begins; ``first`` marks the first code point of each segment."""
        kind, n = self.kind[cp], len(cp)
        at = first.copy()
        at[1:] |= kind[1:] != kind[:-1]
        # the last space of a run before anything else stands alone, or leads what follows if it is a blank
        last = np.zeros(n, dtype=bool)
        last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
        at |= last
        leads = np.flatnonzero(last & (cp == 32))
        at[leads + 1] = False
        # 's 't 'm 'd 're 've 'll where the quote begins a pre-token
        quote = np.flatnonzero(at & (cp == ord("'")))
        quote = quote[quote + 1 < n]
        quote = quote[~first[quote + 1]]
        one = quote[np.isin(cp[quote + 1], [ord(c) for c in "stmd"])]
        two = quote[quote + 2 < n]
        two = two[~first[two + 2]]
        pair = (cp[two + 1].astype(np.int64) << 32) | cp[two + 2]
        two = two[np.isin(pair, [(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")])]
        at[np.concatenate([one, two]) + 1] = False
        for ends in (one + 2, two + 3):
            at[ends[ends < n]] = True
        return np.flatnonzero(at)

    def rounds(self, sym: np.ndarray, seq: np.ndarray, size: int) -> np.ndarray:
        """Symbols left in each of ``size`` sequences; ``seq`` ascends."""
        left = np.bincount(seq, minlength=size)
        rank = np.full(len(sym), NONE)
        rank[:-1] = np.where(seq[:-1] == seq[1:], self.rank(sym[:-1], sym[1:]), NONE)
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            least = np.minimum.reduceat(rank, head)
            least = np.repeat(least, np.diff(np.append(head, len(sym))))
            go = least < NONE
            if not go.all():  # sequences without a pair are finished
                sym, seq, rank, least = sym[go], seq[go], rank[go], least[go]
                continue
            at = np.flatnonzero(rank == least)
            at = at[every_other(np.concatenate([[False], (at[1:] == at[:-1] + 1) & (seq[at[1:]] == seq[at[:-1]])]))]
            left -= np.bincount(seq[at], minlength=size)
            sym[at] = 256 + rank[at]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # places of the products after compaction
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            at = np.concatenate([at, at[at > 0] - 1])
            inner = (at + 1 < len(sym))
            inner[inner] = seq[at[inner]] == seq[at[inner] + 1]
            rank[at] = NONE
            rank[at[inner]] = self.rank(sym[at[inner]], sym[at[inner] + 1])
        return left

    def linked(self, sym: np.ndarray) -> int:
        """Symbols left of one long sequence: the same rounds, places filed by the rank of the pair they begin."""
        n, sym = len(sym), sym.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, filed, queue, left = np.full(n, NONE), {}, [], n

        def file(places: np.ndarray) -> None:
            places = places[after[places] < n]
            r = self.rank(sym[places], sym[after[places]])
            rank[places] = r
            places, r = places[r < NONE], r[r < NONE]
            order = np.argsort(r, kind="stable")
            r, places = r[order], places[order]
            for run in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1) if len(r) else []:
                key = int(r[run[0]])
                if key not in filed:
                    filed[key] = []
                    heapq.heappush(queue, key)
                filed[key].append(places[run])

        file(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(filed.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[every_other(np.concatenate([[False], after[at[:-1]] == at[1:]]))]
            gone = after[at]
            sym[at], rank[gone], rank[at], after[at] = 256 + r, NONE, NONE, after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left -= len(at)
            around = before[at]
            around = around[around >= 0]
            rank[around] = NONE
            file(np.unique(np.concatenate([at, around])))
        return left

    def learn(self, new: list[str]) -> None:
        """Count the tokens of pre-tokens not met before."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        short = [r for r in raw if len(r) <= LONG]
        sym = np.frombuffer(b"".join(short), dtype=np.uint8).astype(np.int64)
        count = np.zeros(len(raw), dtype=np.int64)
        count[size <= LONG] = self.rounds(sym, np.repeat(np.arange(len(short)), size[size <= LONG]), len(short))
        for k in np.flatnonzero(size > LONG):
            count[k] = self.linked(np.frombuffer(raw[k], dtype=np.uint8).astype(np.int64))
        self.seen.update(zip(new, count.tolist(), strict=True))

    def count_segments(self, segments: list[str]) -> np.ndarray:
        """Tokens of each segment, a text or a part of one that is cut by itself."""
        text = "".join(segments)
        size = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        if not text:
            return np.zeros(len(segments), dtype=np.int64)
        ends = np.cumsum(size)
        first = np.zeros(len(text) + 1, dtype=bool)
        first[ends - size] = True
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = self.starts(cp, first[:-1])
        words = [text[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(text)], strict=True)]
        if len(self.seen) > WORDS:
            self.seen.clear()
        new = [w for w in set(words) if w not in self.seen]
        if new:
            self.learn(new)
        count = np.concatenate([[0], np.cumsum(np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words)))])
        for w in new:
            if len(w) > KEPT:
                del self.seen[w]
        return count[np.searchsorted(at, ends)] - count[np.searchsorted(at, ends - size)]

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts that are cut alike alone: a space after something else begins a pre-token, whatever follows."""
        a = 0
        while len(text) - a > SLICE:
            b = a + SLICE
            while b < len(text):
                cp = np.frombuffer(text[b - SLICE:b].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                space = self.kind[cp] == SPACE
                cut = np.flatnonzero(space[1:] & ~space[:-1])
                cut = cut[cut + 1 + b - SLICE > a]
                if len(cut):
                    b = b - SLICE + int(cut[-1]) + 1
                    break
                b = min(b + SLICE - 1, len(text))
            yield text[a:b]
            a = b
        yield text[a:]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        segments, owner, out = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            pieces = self.special.split(t) if t and self.special else [t or ""]
            out[i] = len(pieces) - 1
            for p in pieces:
                if len(p) <= SLICE:
                    segments.append(p)
                    owner.append(i)
                else:
                    out[i] += sum(int(self.count_segments([x])[0]) for x in self.parts(p))
        np.add.at(out, owner, self.count_segments(segments))
        return out


_LOADED: dict[str, Counter] = {}


def counter(v: Vocabulary) -> Counter:
    """The vocabulary's counter, built once in a Python worker."""
    if v.name not in _LOADED:
        _LOADED[v.name] = Counter(v)
    return _LOADED[v.name]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    small_batches(docs.sparkSession)
    v = vocabulary(path)
    names = [f"`{c}`" for c in (id_col, *keep)]
    out = docs.select(*names).schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(v)
        for batch in batches:
            for a, b, texts in slices(batch.column(len(names) + 1), SLICE):
                cols = [batch.column(i).slice(a, b - a) for i in range(len(names) + 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(c.count(texts), pa.int64())], names=out.names)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], F.octet_length(text).cast("long").alias("__b"),
                       text.alias("__t"))
    return rows.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES: dict[str, str] = {}
