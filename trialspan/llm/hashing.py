"""Vectorised hashing of words: whole batches of texts as flat numpy arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 1 << 20  # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public-domain splitmix64 generator: a bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(U(seed) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


_TABLE, _BASE = stream(1, 256) | U(1), 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U(base))
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of a batch: hash, text number, and place in the batch's bytes."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.data, self.size = data, np.array([len(r) for r in raw], dtype=np.int64)
        ends = np.cumsum(self.size + 1)
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))  # words of text i: first[i]..first[i+1]
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = np.zeros(len(self.start), dtype=U)
        a = 0
        with np.errstate(over="ignore"):
            while a < len(self.start):
                b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + BLOCK)))
                lo, hi = int(self.start[a]), int(self.end[b - 1])
                up, down = _powers(hi - lo + 1)
                run = np.zeros(hi - lo + 1, dtype=U)
                np.cumsum(_TABLE[data[lo:hi]] * up[:hi - lo], out=run[1:])
                s, e = self.start[a:b] - lo, self.end[a:b] - lo
                self.hash[a:b] = mix((run[e] - run[s]) * down[s])
                a = b


_STEP = stream(2, 16) | U(1)


def shingles(texts: list[str | None], k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text.

    A text with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    w = Words(texts, lower)
    out = []
    with np.errstate(over="ignore"):
        n = max(0, len(w.hash) - k + 1)
        every = np.zeros(n, dtype=U)
        for i in range(k):
            every += w.hash[i:i + n] * _STEP[i]
        every = mix(every)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(every[a:b - k + 1]))
            elif b > a:
                short = (w.hash[a:b] * _STEP[:b - a]).sum(dtype=U) + U(b - a) * _STEP[15]
                out.append(mix(np.array([short])))
            else:
                out.append(np.zeros(0, dtype=U))
    return out
