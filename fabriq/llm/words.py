"""Word and shingle hashes of whole texts in numpy: a word is a run of bytes other than \\x20 and \\x09-\\x0D, A-Z lower-cased."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(_LOW.astype(np.uint64) * _P + np.uint64(77))
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for k, base in (("p", _P), ("i", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SEP[data]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e = word_spans(data)
    p, inv = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * p[: len(data)], out=c[1:])
    return mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * _P), s, e


def word_hashes(texts: list[str | None], piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, and where each text's words begin (one entry more than texts).

    Works in pieces of about ``piece`` bytes that end between words, so memory doesn't follow the length of a text.
    """
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    at, n = 0, len(texts)
    while at < n:
        part, total, first = [], 0, at
        while at < n and (not part or total < piece):
            raw = (texts[at] or "").encode("utf-8", "surrogatepass")
            part.append(raw)
            total += len(raw) + 1
            at += 1
        data = np.frombuffer(b" ".join(part), np.uint8)
        begins = np.cumsum([0] + [len(x) + 1 for x in part])
        lo = 0
        while lo < len(data):
            hi = min(len(data), lo + 4 * piece)
            while hi < len(data) and not _SEP[data[hi]]:
                hi += 1
            h, s, _ = _hash(data[lo:hi])
            hashes.append(h)
            counts[first + 1 : at + 1] += np.diff(np.searchsorted(s + lo, begins))
            lo = hi
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


_MUL = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n words in a row of an array of word hashes (its length less n-1)."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * _MUL[i % 5] + h[i : i + len(out)])
    return out


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words of the whole sequence; else empty."""
    h, at = word_hashes(texts)
    all_ = chain(h, n)
    out = []
    for i in range(len(texts)):
        lo, hi = int(at[i]), int(at[i + 1])
        if hi - lo >= n:
            out.append(np.unique(all_[lo : hi - n + 1]))
        elif hi > lo:
            out.append(chain(h[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))
