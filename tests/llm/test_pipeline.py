import corpus_pipeline
from stratagrid.llm import decontam, neardup, quality
from stratagrid.session import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert out.columns == columns, name
        if name == "quality_rules":
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in quality.score(docs).where("kept").collect())
        elif name == "minhash_neardup":
            assert sorted(r.doc_id for r in out.collect()) == sorted({r.class_id for r in neardup.classes(docs).collect()})
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.contaminated(docs, table(spark, sf, "benchmark")).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in docs.collect())
    sizes = {}
    for r in last:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    n = [len(sizes.get(k, ())) for k in range(corpus_pipeline.SHARDS)]
    assert max(n) - min(n) <= 1


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_and_empty_rows(spark, sf, odd, empty):
    """Every stage takes what the stage before leaves of odd rows, and nothing."""
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert [c for c in out.columns if c not in ("shard", "slot")] == [c for c in columns if c not in ("shard", "slot")], name
            docs = spark.createDataFrame(rows, out.schema)
    assert all(r.text for r in rows)
