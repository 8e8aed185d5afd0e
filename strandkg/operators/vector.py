"""Exact cosine search, a stated set of queries against all rows, in blocks.

The queries are taken ``BLOCK`` at a time as one matrix that goes to the tasks (its size is bound by ``BLOCK`` and the dimension; the driver holds one block at a time); every task multiplies it with its own rows, in tiles of ``TILE`` scores, and
keeps its ``k`` best per query, so what is shuffled is ``k`` rows per query and task, and neither side is ever joined with the other pair by pair.

Scores are rounded to 1e-6, so that equal vectors tie; ties go to the greater id. A zero vector is similar to nothing (0). Null vectors give no row. NaN scores rank first, take a place
and then fail the threshold, which stands above the rank and is not pushed below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandkg.session import written

BLOCK = 4096
#: Scores held at a time: some ten arrays of eight bytes each.
TILE = 2_000_000
#: Pairs computed in full at a time.
NEAR = 20_000
_HIT = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_DDL = "qid long, id long, score double"


def _unit(rows: list | pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, each scaled to length 1; zero vectors stay."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float) if isinstance(rows, pa.Array) else np.array(rows, float)
    m = flat.reshape(len(rows), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, score, id) of the ``k`` best in each row of ``scores``, NaN first, ties to the greater id. Only what is no worse than the k-th score is sorted."""
    ranked = np.where(np.isnan(scores), np.inf, scores)
    n = ranked.shape[1]
    least = np.partition(ranked, n - k, axis=1)[:, n - k] if k < n else np.full(len(ranked), -np.inf)
    q, i = np.nonzero(ranked >= least[:, None])
    order = np.lexsort((-ids[q, i], -ranked[q, i], q))
    q, i = q[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    kept = place < k
    return q[kept], scores[q[kept], i[kept]], ids[q[kept], i[kept]]


def better(kept: tuple[np.ndarray, np.ndarray], q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Put into ``kept`` (scores and ids of each query's ``k`` best, a row a query) what of the given (query index, score, id) belongs there, in the order of ``best_of``."""
    k, rows = kept[0].shape[1], np.unique(q)
    q = np.concatenate([np.repeat(rows, k), q])
    scores, ids = np.concatenate([kept[0][rows].ravel(), scores]), np.concatenate([kept[1][rows].ravel(), ids])
    order = np.lexsort((-ids, -np.where(np.isnan(scores), np.inf, scores), q))
    q = q[order]
    order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    kept[0][rows], kept[1][rows] = scores[order].reshape(-1, k), ids[order].reshape(-1, k)


def _scan(queries: list[tuple], k: int | None, threshold: float | None):  # noqa: ANN202
    qids, matrix = np.array([q[0] for q in queries], np.int64), _unit([q[1] for q in queries])
    tile = max(16, TILE // max(1, len(queries)))
    rough, margin = matrix.astype(np.float32), 1e-6 + 1.2e-7 * (matrix.shape[1] + 8)  # no single-precision product of unit vectors is further off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # scores and ids of each query's best so far, filled up with what ranks last
        for batch in batches:
            for start in range(0, batch.num_rows, tile):
                part = batch.slice(start, tile)
                ids = part.column("id").to_numpy()
                unit = _unit(part.column("vector"))
                if kept is not None and kept[0].shape[1] == k:  # only what comes near the k-th best so far is computed in full
                    least = np.where(np.isnan(kept[0][:, -1]), np.inf, kept[0][:, -1]) - margin
                    q, i = np.nonzero(~(rough @ unit.T.astype(np.float32) < least[:, None].astype(np.float32)))
                    for at in range(0, len(q), NEAR):
                        some, of = q[at : at + NEAR], i[at : at + NEAR]
                        better(kept, some, np.round(np.einsum("ij,ij->i", matrix[some], unit[of]), 6), ids[of])
                    continue
                scores = np.round(matrix @ unit.T, 6)
                if k is None:
                    q, i = np.nonzero(scores > threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[i]), pa.array(scores[q, i])], schema=_HIT)
                    continue
                every = np.broadcast_to(ids, scores.shape)
                if kept is not None:
                    scores, every = np.concatenate([kept[0], scores], axis=1), np.concatenate([kept[1], every], axis=1)
                q, s, x = best_of(scores, every, k)
                width = min(k, scores.shape[1])
                kept = s.reshape(-1, width), x.reshape(-1, width)
        if kept is not None:
            n = kept[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(kept[1].ravel()), pa.array(kept[0].ravel())], schema=_HIT)

    return run


def _hits(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float | None) -> DataFrame:
    rows = vectors.select(F.col("id").cast("long"), "vector").where("id is not null and vector is not null")
    asked = queries.select(F.col("id").cast("long"), "vector").where("id is not null and vector is not null").orderBy("id").toLocalIterator()
    out, block = None, []

    def add(done: DataFrame | None) -> DataFrame:
        part = rows.mapInArrow(_scan(block, k, threshold), _DDL)
        return part if done is None else done.unionByName(part)

    for q in asked:
        if len(block) == BLOCK:  # a full block is worked off before the next one comes to the driver
            part = written(add(None), "hits")
            out, block = part if out is None else out.unionByName(part), []
        block.append((q["id"], q["vector"]))
    if block:
        out = add(out)
    return out if out is not None else vectors.sparkSession.createDataFrame([], _DDL)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 3, threshold: float | None = 0.3) -> DataFrame:
    """(qid, id, score, rank) of the ``k`` most similar rows of ``vectors`` (id, vector) for each of ``queries`` (id, vector); of these only the
    ones above ``threshold``, so there may be fewer than ``k``."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))
    ranked = _hits(vectors, queries, k, None).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked if threshold is None else ranked.where((F.col("score") > threshold) & ~F.isnan("score"))


def above(vectors: DataFrame, queries: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(qid, id, score) of all rows more similar than ``threshold``."""
    return _hits(vectors, queries, None, threshold)
