"""Texts of an Arrow batch as one array of code points, for work on all of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters worked on at a time: arrays of some ten times eight bytes each come with them.
BLOCK = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def blocks(lengths: list[int], most: int = BLOCK) -> Iterator[slice]:
    """Slices of texts of at most ``most`` characters together; a longer text stands alone, whole."""
    first = total = 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield slice(first, len(lengths))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (one entry more than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each value (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of ``k`` values in a row; windows that cross texts are the caller's to leave out."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 4:
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _A + points[i : i + n].astype(np.uint64) + _B
        return mixed(out)
    # Doubling: the hash of a window of 2m values is made of those of two windows of m, so k values cost log k passes.
    width, parts, out, done = 1, points.astype(np.uint64) * _A + _B, None, 0
    rest = k
    while rest:
        if rest & 1:
            piece = parts[done : done + n]
            out = mixed(piece) if out is None else mixed(out * _A + piece)
            done += width
        rest >>= 1
        if rest:
            m = len(parts) - width
            parts = mixed(parts[:m] * _B + parts[width:])
            width *= 2
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of ``x``, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
