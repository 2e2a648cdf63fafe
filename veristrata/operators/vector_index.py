"""Inverted file over vectors whose probe is exact.

Unit vectors are dealt to the nearest of some centroids, which are fitted on a bounded sample; every vector is in a
list, with its distance to the list's centroid. A query first reads its nearest lists, which gives it k scores to beat.
By the triangle inequality a vector can only beat them if its distance to the centroid differs from the query's by no
more than the distance that the k-th score stands for; in the other lists it is compared with these vectors alone.

Vectors of length zero have the score 0 with everything: they form a list that is always read, and a query of length
zero reads all lists. Null vectors are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize, shared_path
from . import nearest as N

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most
MOST_LISTS = 1_024
MOST_QUERIES = 8_192  # told to all tasks at a time
STEPS = 12  # rounds of the fit
NEAREST = 2  # lists that a query reads first
SLACK = 1e-6  # for rounding in distances, which is largest near 0
NO_LENGTH = -1  # the list of vectors of length zero


def fit_centroids(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centroids of unit vectors by rounds of assignment and mean, from the ``sample`` vectors with the smallest hashes."""
    own = corpus.where("vec IS NOT NULL").orderBy(F.xxhash64(F.lit(seed), "vid")).limit(sample).select("vec").collect()
    rows = np.array([r["vec"] for r in own], dtype=float)
    rows = rows[np.linalg.norm(rows, axis=1) > 0] if len(rows) else rows.reshape(0, 0)
    if not len(rows):
        return rows
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    k = min(lists or max(1, int(np.sqrt(len(rows)))), MOST_LISTS, len(rows))
    centers = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(STEPS):
        at = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


def build(corpus: DataFrame, centers: np.ndarray) -> DataFrame:
    """(vid, vec, far, list): every vector with its list and its distance to the list's centroid, written."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = N.Vectors(batch.column(0), batch.column(1))
            lists, far = np.full(len(rows.ids), NO_LENGTH, np.int32), np.zeros(len(rows.ids))
            for size, place, vecs, norms, _ in rows.parts:
                if len(centers) and size == centers.shape[1]:
                    at = _distances(vecs, norms, centers)
                    lists[place], far[place] = at.argmin(axis=1), at.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far), pa.array(lists)], ["vid", "vec", "far", "list"])

    rows = corpus.where("vec IS NOT NULL").select(F.col("vid").cast("long").alias("vid"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(assign, "vid long, vec array<double>, far double, list int")
    path = shared_path(corpus.sparkSession, "vector-lists")
    rows.repartitionByRange(F.col("list"), F.xxhash64("vid")).write.partitionBy("list").parquet(path)  # a large list in many tasks
    return corpus.sparkSession.read.schema("vid long, vec array<double>, far double, list int").parquet(path)


def _distances(vecs: np.ndarray, norms: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to all centroids."""
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.sqrt(np.maximum(0.0, 2 - 2 * (vecs / norms[:, None]) @ centers.T)), nan=0.0)


def _read_lists(index: DataFrame, block: DataFrame, centers: np.ndarray, k: int, first: bool) -> DataFrame:
    """(qid, vid, score, compared): of each task's vectors the best of each query, and how many it was compared with.

    ``block`` has (qid, qvec), and for the lists after the first ones ``beat``, the k-th score so far (null: none). A
    query's distances to the centroids are worked out in the tasks.
    """
    told = N.asked(block)
    own = index.select("vid", "vec", "list", "far")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = told()
        at, near, reach, beat = _order(queries, centers)
        best, compared = N.Best(len(queries.ids), k), np.zeros(len(queries.ids), np.int64)
        for batch in batches:
            lists = batch.column(2).to_numpy(zero_copy_only=False)
            for one in np.unique(lists if first else lists[lists >= 0]):
                here = pa.array(np.flatnonzero(lists == one))
                rows = N.Vectors(batch.column(0).take(here), batch.column(1).take(here))
                far = batch.column(3).take(here).to_numpy(zero_copy_only=False)
                early = near[:, one] if one >= 0 else np.ones(len(queries.ids), bool)
                for q in queries.parts:
                    for v in rows.parts:
                        d = far[v[1]]
                        asks = early[q[1]] if first else ~early[q[1]]
                        if not first:
                            asks &= (d.min() - reach[q[1]] <= at[q[1], one]) & (at[q[1], one] <= d.max() + reach[q[1]])
                        if not asks.any():
                            continue
                        part = N.part_of(q, asks)
                        compared[part[1]] += _compared(queries, part, rows, v, None if first else (d, at[part[1], one], reach[part[1]]))
                        few = N.few_copies(v, rows.ids, k + 1, alike=q[0] != v[0])
                        d = far[few[1]]
                        within = None if first else lambda s, d=d, part=part, one=one: np.abs(d[None, s] - at[part[1], one][:, None]) <= reach[part[1]][:, None]
                        N.scan(best, queries, part, rows, few, beat, True, within)
        q, place = np.nonzero(best.ids >= 0)
        scores = best.scores[q, place]
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(best.ids[q, place]), pa.array(np.where(np.isposinf(scores), np.nan, scores)), pa.nulls(len(q), pa.int64())], _NAMES)
        some = np.flatnonzero(compared)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[some]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64()), pa.array(compared[some])], _NAMES)

    return materialize(own.mapInArrow(search, "qid long, vid long, score double, compared long"), "lists-read")


_NAMES = ["qid", "vid", "score", "compared"]


def _order(queries: N.Vectors, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: distances to the centroids, whether a list is among its nearest, how far a vector may be that
    beats its k-th score, and that score. A query without length reads all lists."""
    n, lists = len(queries.ids), len(centers)
    at, near = np.zeros((n, lists)), np.zeros((n, lists), bool)
    beat = np.full(n, -np.inf) if queries.more is None else np.where(np.isnan(queries.more), -np.inf, queries.more)
    reach = np.where(np.isneginf(beat), np.inf, np.sqrt(np.maximum(0.0, 2 - 2 * beat))) + SLACK
    for size, place, rows, norms, _ in queries.parts:
        if lists and size == centers.shape[1]:
            at[place] = _distances(rows, norms, centers)
        else:
            reach[place] = np.inf
    if lists:
        np.put_along_axis(near, np.argsort(at, axis=1, kind="stable")[:, :NEAREST], True, axis=1)
    return at, near, reach, beat


def _compared(queries: N.Vectors, q: tuple, rows: N.Vectors, v: tuple, within: tuple | None) -> np.ndarray:
    """How many vectors of a part each query is compared with: those within reach, not itself."""
    if within is None:
        n = np.full(len(q[1]), len(v[1]), np.int64)
        counted = None
    else:
        d, at, reach = within
        order = np.sort(d)
        n = np.searchsorted(order, at + reach, "right") - np.searchsorted(order, at - reach, "left")
        counted = lambda qi, vi: np.abs(d[vi] - at[qi]) <= reach[qi]
    qi, vi = N.own_pairs(queries.ids[q[1]], rows.ids[v[1]])
    np.subtract.at(n, qi, 1 if counted is None else counted(qi, vi).astype(np.int64))
    return n


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    return scored.where("vid IS NOT NULL").select("qid", "vid", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: DataFrame, centers: np.ndarray, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, read): the exact top k (qid, vid, score, rank), ties by vid, and how many vectors each query was compared with.

    ``queries`` (qid, qvec) is a stated set, answered in blocks of MOST_QUERIES; no vector is its own neighbour.
    """
    queries = queries.where("qvec IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    hits, read = [], []
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        start = _read_lists(index, part, centers, k, True)
        beat = _best(start, k).where(F.col("rank") == k).select("qid", F.col("score").alias("beat"))
        rest = _read_lists(index, part.join(beat, "qid", "left"), centers, k, False)
        found = start.unionByName(rest)
        hits.append(_best(found, k))
        read.append(found.where("compared IS NOT NULL").groupBy("qid").agg(F.sum("compared").alias("compared")))
    for h, r in zip(hits[1:], read[1:], strict=True):
        hits[0], read[0] = hits[0].unionByName(h), read[0].unionByName(r)
    return hits[0], read[0]
