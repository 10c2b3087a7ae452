"""Vectorised word hashes over batches of texts (inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers for positions in a word and in a shingle.
_P = 0x9E3779B97F4A7C15
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words made of letters, digits and anything beyond ASCII.
_PUNCT = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _P, U)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


def batches(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in runs of about ``limit`` bytes; null: empty."""
    rows, first, size = [], 0, 0
    for at in range(0, len(column), 256):  # never all texts as Python objects at once
        for i, t in enumerate(column.slice(at, 256).cast(pa.binary()).to_pylist(), at):
            rows.append(t or b"")
            size += len(rows[-1])
            if size >= limit:
                yield first, rows
                rows, first, size = [], i + 1, 0
    if rows:
        yield first, rows


def words(texts: list[bytes], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words of the texts, and for each text
    the index of its first word (one more at the end).

    Words are runs of ``[^\\x20\\x09-\\x0D]``; ``plain``: of letters, digits and
    non-ASCII bytes.
    """
    a = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~(_PUNCT if plain else _SPACE)[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, lens = edge[::2], edge[1::2] - edge[::2]
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(size))))
    if not len(starts):
        return np.empty(0, U), bounds
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    h = (a[inside].astype(U) + U(1)) * _power(int(lens.max()))[pos]
    return mix(np.add.reduceat(h, at) + lens.astype(U) * U(_ODD[4])), bounds


def window_hashes(h: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """A hash for each word taken with those ``steps`` further on."""
    n = len(h) - steps[-1]
    if n <= 0:
        return np.empty(0, U)
    out = h[:n] * U(_ODD[0]) + U(sum(steps) + len(steps))
    for i, s in enumerate(steps):
        out = out + h[s : s + n] * U(_ODD[(i + 1) % 5] ^ (2 * (i // 5)))
    return mix(out)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of
    fewer words the whole sequence as one, of none an empty array."""
    h, bounds = words(texts)
    full = window_hashes(h, tuple(range(1, n))) if n > 1 else mix(h)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= n:
            s = np.sort(full[lo : hi - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            seq = h[lo:hi]
            out.append(mix(np.array([int((seq * np.array(_ODD[: hi - lo] if hi - lo <= 5 else [_P] * (hi - lo), U)).sum()) & (2**64 - 1)], U) + U(hi - lo)))
        else:
            out.append(np.empty(0, U))
    return out
