"""Splitting oversized texts at natural boundaries (problem 3).

Recursive bisection: a stretch that is too long is cut at the strongest boundary near its midpoint, and both halves are cut on while they exceed the
limit less the overlap (the first piece carries no overlap and may reach the limit). A sentence or line end is taken wherever one lies inside the stretch, near the midpoint if
there; clause marks and spaces only where the stretch holds none; a cut at no mark at all only where it holds nothing of these. Then each piece but the
first gets the last ``overlap`` characters before it in front.

Lengths are code points. Only texts over the limit reach Python; nothing is shuffled. Null, empty and short texts give one piece or none: null none,
others themselves. Whole texts, of any length, are processed. Repeated rows give pieces each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 60
#: Ends of lines and of sentences, then clauses, then words: stronger first.
_levels = [re.compile(r"\n+"), re.compile(r"[。！？；]"), re.compile(r"[.!?;](?=\s)|[，、：,:]"), re.compile(r"\s+")]
_marks = "。！？；\n"


def _cuts(text: str) -> list[list[int]]:
    return [[m.end() for m in p.finditer(text)] for p in _levels]


def _best(cuts: list[list[int]], low: int, high: int) -> tuple[int, int]:
    """The place to cut between ``low`` and ``high``, and its level."""
    middle, quarter = (low + high) // 2, max(1, (high - low) // 4)

    def nearest(points: list[int], a: int, b: int) -> int | None:
        i, j = bisect_left(points, a), bisect_right(points, b)
        k = bisect_left(points, middle, i, j)
        near = [points[x] for x in (k - 1, k) if i <= x < j]
        return min(near, key=lambda x: (abs(x - middle), x)) if near else None

    for group in ((0, 1), (2,), (3,)):  # sentence and line ends stand above all else, wherever they are
        for a, b in ((middle - quarter, middle + quarter), (low + 1, high - 1)):
            for level in group:
                if (at := nearest(cuts[level], max(a, low + 1), min(b, high - 1))) is not None:
                    return at, level
    return middle, len(cuts)


def bisect(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], int]:
    """Where the pieces of ``text`` end, each with the level of its cut (0 strongest; -1 at the end of the text), and the longest stretch without a sentence or line end that had to be cut (0: none)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    cuts, out, todo, longest = _cuts(text), [], [(0, len(text), -1, True)], 0
    while todo:
        low, high, level, whole = todo.pop()
        if high - low <= limit - (overlap if low else 0):
            out.append((high, level))
            continue
        at, cut = _best(cuts, low, high)
        if cut > 1 and whole:  # between two natural ends: no part of a stretch met before
            longest = max(longest, len(text[low:high].rstrip(_marks)))
        todo += [(at, high, level, cut < 2), (low, at, cut, cut < 2)]
    return out, longest


def pieces(ends: list[tuple[int, int]], overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, level) of each piece, the overlap included."""
    out, low = [], 0
    for high, level in ends:
        out.append((max(0, low - overlap) if low else 0, high, level))
        low = high
    return out


_PIECE = pa.schema([("row_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("level", pa.int32()), ("forced_run", pa.int32())])


def split_texts(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all texts of ``texts`` (row_id, text) over the limit, with the longest stretch of their text that had to be cut where no sentence or line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row_id, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ends, forced = bisect(text, limit, overlap)
                rows += [(row_id, k, a, b, text[a:b], level, forced) for k, (a, b, level) in enumerate(pieces(ends, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, (x.type for x in _PIECE), strict=True)], schema=_PIECE)

    over = texts.select("row_id", "text").where(F.length("text") > limit)
    return over.mapInArrow(run, "row_id long, piece int, start int, end int, text string, level int, forced_run int")
