"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables projects a vector on ``width`` Gaussian directions and cuts each projection into cells of
a fixed size; the cells are the bucket. A query looks into its own bucket and into those that are most likely to hold a
neighbour: perturbed by one cell in some directions, in order of the sum of squared distances to the cell borders that
are crossed. Candidates of all tables are merged after exact distances in double precision on the original vectors.

A bucket may hold any share of all vectors, so buckets are dealt on by id to ``SALTS`` parts and queries visit all of
them; within a part, vectors stream past the queries. Queries that found fewer than k candidates are compared with all
vectors, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm import blocks
from treeloom.llm.common import lean, partitions, small, written

TABLES, SALTS, SEED = 8, 8, 29
#: Most directions of a table: with more, tables and probes as they are reach too few cells for a recall of 0.9.
WIDEST = 8
#: Vectors from which the cell size is fitted: those of the smallest hash of their id.
SAMPLE = 1000
#: Vectors that a task compares with the queries of a bucket at once.
AT_ONCE = 2048

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def width_for(n: int) -> int:
    """Directions of a table for n vectors: half the bits of n, so that buckets stay populated, up to WIDEST, so that recall doesn't fall as n grows."""
    return int(min(WIDEST, max(4, round(math.log2(max(n, 2)) / 2))))


def probes(place: np.ndarray, most: int) -> list[tuple[tuple[int, int], ...]]:
    """Perturbations ((direction, step), ...) by falling estimated success, the empty one first. place: where in its cell (0 to 1) the query lies in each direction."""
    moves = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(place)] + [(float(1 - x) ** 2, i, 1) for i, x in enumerate(place)])
    out: list[tuple[tuple[int, int], ...]] = [()]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < most:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
        if len({moves[c][1] for c in chosen}) == len(chosen):
            out.append(tuple((moves[c][1], moves[c][2]) for c in chosen))
    return out


class Tables:
    """The hash tables for one number of dimensions."""

    def __init__(self, dims: int, width: int, cell: float, tables: int = TABLES, seed: int = SEED) -> None:
        rng = np.random.default_rng([seed, dims])
        self.directions = rng.standard_normal((tables, dims, width))
        self.shift = rng.uniform(0, 1, (tables, width))
        self.mix = rng.integers(1, 1 << 62, (tables, width), dtype=np.int64) | 1
        self.start = rng.integers(1, 1 << 62, tables, dtype=np.int64)
        self.cell = cell

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return np.clip(vectors @ self.directions[table] / self.cell + self.shift[table], -(2.0**40), 2.0**40)

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix[table]).sum(axis=-1) + self.start[table]


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision from the differences themselves."""
    out = np.empty((len(queries), len(vectors)))
    for k, q in enumerate(queries):
        d = vectors - q
        out[k] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


class _Best:
    """The k nearest of each query that a task has seen."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ids != query
        old = self.held.get(query)
        if old is not None:
            if len(old[1]) >= self.k:
                keep &= scores <= old[1][-1]
            if not keep.any():
                return
            ids, scores = np.concatenate((old[0], ids[keep])), np.concatenate((old[1], scores[keep]))
        else:
            ids, scores = ids[keep], scores[keep]
        if len(ids) > 8 * self.k:
            near = scores <= np.partition(scores, self.k * 4)[self.k * 4]  # ids may come twice or more, once a table
            if len(np.unique(ids[near])) >= self.k:
                ids, scores = ids[near], scores[near]
        order = np.lexsort((ids, scores))
        ids, scores = ids[order], scores[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: self.k]
        self.held[query] = (ids[first], scores[first])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for query, (ids, scores) in self.held.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(scores)], schema=FOUND)


def _matrix(column: pa.Array) -> list[np.ndarray]:
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[edges[k] : edges[k + 1]] for k in range(len(column))]


def _entries(rows: DataFrame, width: int, cell: float, n_probes: int, queries: bool) -> DataFrame:
    """(key, salt, kind, id, v): a row for each table (vectors), or for each table, probe and salt (queries, of kind 0)."""
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in source:
            ids, vectors = batch.column(0).to_pylist(), _matrix(batch.column(1))
            keys, salts, at = [], [], []
            for dims in sorted({len(v) for v in vectors}):
                own = [k for k, v in enumerate(vectors) if len(v) == dims]
                stack = np.stack([vectors[k] for k in own])
                if dims not in known:
                    known[dims] = Tables(dims, width, cell)
                tables = known[dims]
                for t in range(TABLES):
                    place = tables.places(stack, t)
                    cells = np.floor(place)
                    if not queries:
                        keys += tables.keys(cells, t).tolist()
                        salts += [ids[k] % SALTS for k in own]
                        at += own
                        continue
                    for n, k in enumerate(own):
                        moved = np.repeat(cells[n][None], n_probes, axis=0)
                        steps = probes(place[n] - cells[n], n_probes)
                        for p, step in enumerate(steps):
                            for i, s in step:
                                moved[p, i] += s
                        got = np.unique(tables.keys(moved[: len(steps)], t)).tolist()
                        keys += [x for x in got for _ in range(SALTS)]
                        salts += [*range(SALTS)] * len(got)
                        at += [k] * (len(got) * SALTS)
            for k in range(0, len(keys), 8192):
                part = pa.array(at[k : k + 8192], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 8192], pa.int64()), pa.array(salts[k : k + 8192], pa.int32()), pa.array(np.full(len(part), 0 if queries else 1, np.int32)), batch.column(0).take(part), batch.column(1).cast(pa.list_(pa.float64())).take(part)], schema=schema)

    return rows.mapInArrow(lean(run), "key long, salt int, kind int, id long, v array<double>")


def _compare(source: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, salt, kind): the queries of each part come before its vectors."""
    best, part, q_ids, q_rows, matrix = _Best(k), None, [], [], None
    for batch in source:
        ids = batch.column(3).to_numpy(zero_copy_only=False)
        kind = batch.column(2).to_numpy(zero_copy_only=False)
        mark = np.stack((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)), 1)
        rows = _matrix(batch.column(4))
        edge = np.flatnonzero(np.concatenate(([True], (mark[1:] != mark[:-1]).any(1) | (kind[1:] != kind[:-1]), [True])))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if part != tuple(mark[a]):
                part, q_ids, q_rows, matrix = tuple(mark[a]), [], [], None
            if kind[a] == 0:
                q_ids += ids[a:b].tolist()
                q_rows += [r.copy() for r in rows[a:b]]
                matrix = None
            elif q_ids:
                dims = len(rows[a])
                if matrix is None:
                    matrix = np.stack([r for r in q_rows if len(r) == len(q_rows[0])])
                if matrix.shape[1] != dims:
                    continue
                for s in range(a, b, AT_ONCE):
                    stack = np.stack(rows[s : min(b, s + AT_ONCE)])
                    found = distances(matrix, stack)
                    for n, q in enumerate(q_ids):
                        best.add(q, ids[s : min(b, s + AT_ONCE)], found[n])
    yield from best.rows()


def _all_distances(each: Iterator[tuple], k: int) -> Iterator[pa.RecordBatch]:
    for _, ids, rows, query_blocks in each:
        for qs, queries in query_blocks():
            best = _Best(k)
            found = distances(queries, rows)
            for n, query in enumerate(qs.tolist()):
                best.add(query, ids, found[n])
            yield from best.rows()


def cell_size(rows: DataFrame) -> float:
    """1.41 times the median distance between the vectors of a bounded sample (those of the most frequent length)."""
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    if len(sample) < 2:
        return 1.0
    dims = max({len(v) for v in sample}, key=lambda n: (sum(len(v) == n for v in sample), n))
    stack = np.array([v for v in sample if len(v) == dims])
    shuffled = stack[np.random.default_rng(SEED).permutation(len(stack))]
    each = np.sqrt(((stack - shuffled) ** 2).sum(1))
    each = each[each > 0]
    return 1.41 * float(np.median(each)) if len(each) else 1.0


def search(vectors: DataFrame, is_query: F.Column, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by Euclidean distance, ties to the smaller id.

    is_query is a condition on _id, the row's key. Every other usable vector of the same length is a candidate. Null
    keys, and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another
    length are never compared. Repeated keys are one vector that may lie in several places: its nearest counts. Fewer
    than k candidates give all of them; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(blocks.usable(vectors, key, column, zero=False), "vectors")
    queries = rows.withColumnRenamed("id", "_id").where(is_query).withColumnRenamed("_id", "id")
    n = rows.count()
    width, cell = width_for(n), cell_size(rows)
    entries = _entries(queries, width, cell, 10 * width, True).union(_entries(rows, width, cell, 0, False))
    dealt = entries.repartition(partitions(spark), "key", "salt").sortWithinPartitions("key", "salt", "kind")
    partial = written(dealt.mapInArrow(lean(lambda source: _compare(source, k)), "query_id long, vec_id long, score double"), "near")
    order = [F.col("score").asc(), F.col("vec_id").asc()]
    once = partial.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    enough = once.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("id"))
    starved = written(queries.join(small(enough), "id", "left_anti"), "starved")
    if not starved.isEmpty():
        parts = partitions(spark)
        of_rows, of_queries = blocks.packed(rows, max(parts, n // blocks.ROWS), parts), blocks.packed(starved, max(1, starved.count() // blocks.ROWS), parts)
        rest = blocks.met(of_rows, of_queries, lambda each: _all_distances(each, k), "query_id long, vec_id long, score double")
        once = once.union(rest).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return blocks.best(once, k, order)
