"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A batch of texts is cut into words (a run of space marks and what follows it; no merge crosses that cut, which
is checked against the model), each distinct word is encoded once. The symbols of all distinct words lie in one
flat array. Each round finds the least pair rank of every word (segmented minimum), merges it there at the same
time for all words, looks up the ranks of the pairs that changed, and compacts the arrays, until no pair is
left. A word merges its leftmost least pair; it merges all of them at once only where no longer piece around
the merged one could come first, so the result is that of one merge at a time. Words of over ``LONG`` symbols
(no space for thousands of characters) use a heap with the same order instead, so that cost stays near-linear.

Defined cases: a null or empty text has no ids and decodes to an empty text; unknown characters become byte
pieces; texts of any length are encoded whole; repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import read, small_batches

MARK = "▁"
LONG = 2048  # symbols
CHARS = 300_000  # bytes of text encoded at a time
WORDS = 100_000  # distinct words a task remembers
NONE = np.int64(1) << 30


def _each_byte(e: UnicodeError):
    return "�", e.start + 1


class Pieces:
    """Encoder and decoder of one model, from its serialised bytes."""

    def __init__(self, model: bytes):
        import codecs

        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {piece[i]: i for i in normal}
        if any(sp.is_unused(i) for i in normal) or any(MARK in piece[i].lstrip(MARK) for i in normal):
            raise ValueError("the model has pieces that this encoder does not cut words by")
        if any(c not in ids for i in normal for c in piece[i]):
            raise ValueError("the model has pieces with a character that is none itself")
        # equal scores share a rank; smaller ranks merge first
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        rank = np.full(n, NONE)
        rank[normal] = [order[sp.get_score(i)] for i in normal]
        around = np.full(n, NONE)  # least rank of the pieces that begin or end with a piece
        pairs = {}
        for i in normal:
            p = piece[i]
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                for part in (a, b):
                    if part is not None:
                        around[part] = min(around[part], rank[i])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.n, self.rank, self.pair_keys = n, rank, np.append(keys, np.iinfo(np.int64).max)
        self.pair_ids = np.array([pairs[k] for k in keys] + [0], dtype=np.int64)
        self.alone = around > rank
        self.pairs, self.char = pairs, np.full(0x110000, -1, dtype=np.int64)
        for c, i in ids.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.byte0 = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # white space that is no part of a piece ends a word as well
        cuts = "".join(c for c in "\n\t\r" if c not in ids)
        self.words = re.compile(f"{MARK}*[^{MARK}{cuts}]+|{MARK}+" + (f"|[{cuts}]" if cuts else ""))
        byte = dict(zip(self.byte0, range(256), strict=True))
        surface = [b"" if sp.is_control(i) else bytes([byte[i]]) if i in byte else " ⁇ ".encode() if sp.is_unknown(i)
                   else piece[i].replace(MARK, " ").encode() for i in range(n)]
        self.size = np.array([len(x) for x in surface], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.marked = np.array([i in ids.values() for i in range(n)]) & np.array([p.startswith(MARK) for p in piece])
        self.forget()
        codecs.register_error("each_byte", _each_byte)

    # words met so far: word -> number; their ids lie in one array
    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.text: list[str] = []
        self.ids = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(1, dtype=np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two symbols make, -1 if none."""
        key = left * self.n + right
        k = np.searchsorted(self.pair_keys, key)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[k] == key), self.pair_ids[k], -1)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and their words; ``word`` ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(sym), -1)
        made[:-1] = np.where(word[:-1] == word[1:], self.merged(sym[:-1], sym[1:]), -1)
        while len(sym):
            r = np.where(made >= 0, self.rank[made], NONE)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(head, len(sym)))
            least = np.minimum.reduceat(r, head)
            open_ = np.repeat(least < NONE, count)
            if not open_.all():  # words without a pair are finished
                done.append((sym[~open_], word[~open_]))
                sym, word, made, r = sym[open_], word[open_], made[open_], r[open_]
                count, least = count[least < NONE], least[least < NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(r == np.repeat(least, count))
            start = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])  # leftmost of its word
            free = self.alone[made[at]]
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1)]) | start
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[start | (free & ((np.arange(len(at)) - begin) % 2 == 0))]
            sym[at] = made[at]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # places of the merged symbols after compaction
            made[at] = -1
            sym, word, made = sym[stay], word[stay], made[stay]
            for k in (moved, moved[moved > 0] - 1):
                k = k[k + 1 < len(sym)]
                made[k] = np.where(word[k] == word[k + 1], self.merged(sym[k], sym[k + 1]), -1)
            made[-1:] = -1
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (sym, word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def merge_long(self, sym: list[int]) -> list[int]:
        """The same merges for one very long word, by a heap over (rank, place)."""
        n, sym = len(sym), list(sym)
        nxt, prv, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (m := self.pairs.get(sym[i] * self.n + sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, j, sym[i], sym[j], m))

        gone = [False] * n
        for i in range(n):
            offer(i)
        while heap:
            _, i, j, a, b, m = heapq.heappop(heap)
            if gone[i] or gone[j] or nxt[i] != j or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], nxt[i] = m, True, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [i for i in range(n) if not gone[i]], [sym[i] for i in range(n) if not gone[i]]

    def learn(self, new: list[str]) -> None:
        """Encode words not met before."""
        lens = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        cp = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym, word = self.char[cp], np.repeat(np.arange(len(new)), lens)
        place = np.arange(len(cp))
        unknown = sym < 0
        sym = np.where(unknown, -1 - place, sym)  # an unknown character keeps its place, so that it is found again
        short = np.repeat(lens <= LONG, lens)
        out = [self.merge_rounds(sym[short].copy(), word[short])]
        for w in np.flatnonzero(lens > LONG):
            _, s = self.merge_long(sym[word == w].tolist())
            out.append((np.array(s, dtype=np.int64), np.full(len(s), w)))
        sym, word = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        bad = np.flatnonzero(sym < 0)
        if len(bad):  # byte pieces
            raw = [[self.byte0[b] for b in chr(cp[-1 - s]).encode("utf-8", "surrogatepass")] for s in sym[bad]]
            reps = np.ones(len(sym), dtype=np.int64)
            reps[bad] = [len(x) for x in raw]
            word = np.repeat(word, reps)
            at = (np.cumsum(reps) - reps)[bad]
            sym = np.repeat(sym, reps)
            sym[np.concatenate([np.arange(a, a + len(x)) for a, x in zip(at, raw, strict=True)])] = np.concatenate(raw)
        if len(self.seen) + len(new) > WORDS:
            self.forget()
        base, off = len(self.text), np.searchsorted(word, np.arange(len(new) + 1))
        self.first = np.concatenate([self.first, off[1:] + self.first[-1]])
        self.ids = np.concatenate([self.ids, sym])
        text = list(map(str, sym.tolist()))
        self.text += [",".join(text[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        self.seen.update(zip(new, range(base, base + len(new)), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, one after the other; ids per text; ids of each text joined by commas."""
        words = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        every = set().union(*words)
        if len(every) + len(self.seen) > WORDS:
            self.forget()
        if new := [w for w in every if w not in self.seen]:
            self.learn(new)
        num = np.fromiter((self.seen[w] for ws in words for w in ws), dtype=np.int64, count=sum(map(len, words)))
        size = self.first[num + 1] - self.first[num]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[num] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([0, *map(len, words)])
        per = np.concatenate([[0], ends])[last]
        text, joined = self.text, []
        for ws in words:
            joined.append(",".join([text[self.seen[w]] for w in ws]))
        return ids, np.diff(per), joined

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: bytes of the pieces, without the space mark in front of a text."""
        size = self.size[ids]
        ends = np.cumsum(size)
        raw = self.bytes[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        byte_at, out, i = np.concatenate([[0], ends]), [], 0
        for c in counts.tolist():
            a, b, k = int(byte_at[i]), int(byte_at[i + c]), i
            while k < i + c and self.silent[ids[k]]:
                k += 1
            if k < i + c and self.marked[ids[k]]:
                a += 1
            out.append(raw[a:b].decode("utf-8", "each_byte"))
            i += c
        return out


_LOADED: dict[bytes, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The model's encoder, built once in a Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def slices(column: pa.Array, chars: int = CHARS) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of a column of texts with about ``chars`` bytes and their texts, so that memory does not follow a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chars, side="right")))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    ``keep`` names columns of ``docs`` that pass through.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    names = [f"`{c}`" for c in (id_col, *keep)]
    schema = docs.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for a, b, texts in slices(batch.column(len(names))):
                ids, counts, joined = p.encode(texts)
                back = p.decode(ids, counts)
                cols = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                cols += [pa.array(counts, pa.int64()), pa.array(list(map(sha, joined)), pa.string()),
                         pa.array(list(map(sha, back)), pa.string())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    out = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        out = out.add("ids", ArrayType(IntegerType()))
    return docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], F.col(text_col).alias("__t")).mapInArrow(run, out)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: doc_id, text. A null list decodes to an empty text."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int64)
            back = p.decode(flat, np.array([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=[id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, rows.select(id_col).schema.add("text", "string"))


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), model_path(), with_ids=False)


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
