"""Operators with adaptive plans and more partitions, blocks and copies than the other tests have; against SQL and brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import blocks, mixing, neighbours, topk, warc

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def adaptive(spark):
    new = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "7"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    return con.execute(sql).fetchall()


def test_topk_over_several_blocks(adaptive, monkeypatch):
    """Blocks of 16 vectors, whole numbers with many ties at the last rank, every tenth row twice."""
    monkeypatch.setattr(blocks, "ROWS", 16)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-1, 2, 5)]) for k in range(300)]
    docs = adaptive.createDataFrame(rows + rows[::10], "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in topk.search(docs, F.col("_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())
    single = adaptive.createDataFrame(rows, "vec_id long, embedding array<double>").toArrow()
    assert got == sorted(_sql(topk.ORACLE, embeddings=single))


def test_recall_of_the_given_vectors(adaptive):
    vectors = adaptive.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {(r["query_id"], r["vec_id"]) for r in neighbours.search(vectors, F.col("_id") % 100 == 0).collect()}
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect() if r["embedding"] is not None}
    ids, all_ = np.array(list(rows)), np.stack(list(rows.values()))
    near = set()
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((all_ - rows[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near |= {(q, int(x)) for x in ids[np.lexsort((ids, d))[:10]]}
    assert len(found) == len(near) and len(found & near) >= 0.9 * len(near)


def test_neighbours_of_starved_queries(adaptive, monkeypatch):
    """Queries without enough candidates in their buckets are compared with everything; vectors of two lengths don't meet; ties go to the smaller id."""
    monkeypatch.setattr(blocks, "ROWS", 8)
    monkeypatch.setattr(neighbours, "TABLES", 1)
    rows = [(k, [float(k % 7), float(k % 3), 1.0]) for k in range(60)] + [(100 + k, [1.0, float(k)]) for k in range(30)] + [(500, [1e6, -1e6, 5.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.search(adaptive.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("_id") % 100 == 0).collect()}
    own = dict(rows)
    for q in (0, 100, 500):
        order = sorted((float(np.sqrt(((np.array(v) - np.array(own[q])) ** 2).sum())), k) for k, v in rows if k != q and len(v) == len(own[q]))[:10]
        assert [got[q, n + 1] for n in range(10)] == [(k, d) for d, k in order]


def test_mixing_and_archives(adaptive):
    docs, pages = (adaptive.read.parquet(f"{TABLES}/{t}.parquet").repartition(5) for t in ("documents", "pages"))
    mixed = mixing.with_leaf(mixing.mix(docs)).select("doc_id", "_leaf.domain", "_leaf.lang", "_leaf.source", "epoch", "n_tokens")
    assert sorted(map(str, map(tuple, mixed.collect()))) == sorted(map(str, _sql(mixing.oracle(), documents=docs.toArrow())))
    back = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, _sql(warc.ORACLE, pages=pages.toArrow())))
