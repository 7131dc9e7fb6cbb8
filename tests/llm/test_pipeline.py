"""The stages of the pipeline on the smallest tables."""

import corpus_pipeline
from treeloom.llm import jaccard


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        n = docs.count()
        assert docs.columns == columns and 0 < n <= before, name
        before = n
        seen.append(n)
        if name == "near duplicates":
            roots = jaccard.join(docs).select("component_id").distinct().count()
            assert roots == n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    rows = last.collect()
    assert len(rows) == seen[-1] and all(len(r["token_ids"]) > 0 and r["decoded"] for r in rows)


def test_stages_begin_with_garbage_collected(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = full()
    corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert full() > before
