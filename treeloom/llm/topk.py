"""Exact top-k inner products by the threshold algorithm.

Vectors are dealt to blocks. Within a block each dimension has its list of vectors sorted by value. A query goes down
all lists of its non-zero dimensions at once, from the end that its sign favours; each vector that it meets is scored
in full, and no vector farther down can score more than the sum of the values where the lists stand now. The walk ends
when the kth best score so far, of this block and those before it in the task, is above that bound.

A task sorts the lists of a block once and walks them for all queries. How much is scored depends on the vectors: where
a few dimensions carry most of a score, walks end early; in vectors of independent directions of equal weight the bound
is above the kth score until nearly all of a block has been met, whatever the order of the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import blocks
from treeloom.llm.common import forget, partitions, written

SCALE = 1024
#: Entries of each list that are taken at first; each further step takes twice as many.
STEP = 16

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers; held within 62 bits."""
    return np.clip(np.floor(vectors * float(scale)), -(2.0**62), 2.0**62).astype(np.int64)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond 64 bits are held at the ends of their range."""
    top = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if top < 2.0**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if top < 2.0**62:
        return rows @ query
    exact = rows.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


class Lists:
    """The sorted lists of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.floats = vectors.astype(np.float64)
        self.exact = float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        self.repeated = len(np.unique(ids)) < len(ids)

        self.walked = self.scored = 0

    def top(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at most k different ids other than the query's own with the highest scores (ties to smaller ids), without those that score under floor. Of a repeated id the highest score counts."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        weights = query[used]
        in_floats = self.exact * float(np.abs(query).max(initial=0)) < 2.0**53
        of_query = query.astype(np.float64)
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, STEP
        while at < n:
            if len(used) and at + step < n:
                stop = at + step
                rank = np.where(weights > 0, -1, 1)
                place = np.arange(at, stop)[:, None]
                met = self.order[np.where(rank < 0, n - 1 - place, place), used]
                mark = np.zeros(n, bool)
                mark[met.ravel()] = True
                fresh = np.flatnonzero(mark & ~seen)
                seen |= mark
                bound = sum(int(w) * int(v) for w, v in zip(weights, self.vectors[met[-1], used], strict=True))
            else:
                stop, fresh, bound = n, np.flatnonzero(~seen), None
            self.scored += len(fresh)
            got = (self.floats[fresh] @ of_query).astype(np.int64) if in_floats else _products(self.vectors[fresh], query)
            keep = self.ids[fresh] != query_id
            if floor is not None:
                keep &= got >= floor
            ids, scores = np.concatenate((ids, self.ids[fresh][keep])), np.concatenate((scores, got[keep]))
            if len(ids) > k or self.repeated:
                order = np.lexsort((ids, ~scores))  # ~x falls as x grows, without leaving 64 bits
                if self.repeated:  # copies must not fill the k places, nor raise the floor
                    order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
                ids, scores = ids[order[:k]], scores[order[:k]]
            if bound is not None:
                if floor is not None and bound < floor:
                    break
                if len(ids) >= k and int(scores.min()) > bound:
                    break
            at, step = stop, step * 2
        self.walked += n
        return ids, scores


def search(vectors: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row, ties to the smaller id.

    is_query is a condition on _id, the row's key. Components are floor(scale * x). Every row of the same length but the
    query's own is a candidate. Null keys, and vectors that are null, empty, or hold null or non-finite components take
    no part; zero vectors do. Of repeated keys the higher score counts. Fewer than k candidates give all of them.
    """
    spark = vectors.sparkSession
    rows = written(blocks.usable(vectors, key, column, zero=True), "lists")
    queries = rows.withColumnRenamed("id", "_id").where(is_query).withColumnRenamed("_id", "id")
    n, parts = rows.count(), partitions(spark)
    of_rows, of_queries = blocks.packed(rows, max(parts, n // blocks.ROWS), parts), blocks.packed(queries, max(1, queries.count() // blocks.ROWS), parts)
    partial = written(blocks.met(of_rows, of_queries, lambda each: _top(each, k, scale), "query_id long, vec_id long, score long"), "top")
    once = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    for table in (rows, of_rows, of_queries):
        forget(table)
    return blocks.best(once, k, [F.col("score").desc(), F.col("vec_id").asc()])


def _top(each: Iterator[tuple], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    floors: dict[int, int] = {}
    for _, ids, own, query_blocks in each:
        lists = Lists(ids, quantized(own, scale))
        for qs, vectors in query_blocks():
            for query, v in zip(qs.tolist(), quantized(vectors, scale), strict=True):
                found, scores = lists.top(query, v, k, floors.get(query))
                if len(found) >= k:
                    floors[query] = max(floors.get(query, -(2**63)), int(scores.min()))
                    if len(floors) > 1_000_000:
                        floors.clear()
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query)), pa.array(found), pa.array(scores)], schema=FOUND)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(generate_series(1, len(v.e)), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
