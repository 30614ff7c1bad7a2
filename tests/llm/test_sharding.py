import random
import zlib
from collections import Counter


from stratagrid.llm import sharding
from stratagrid.session import table


def laws(docs, shards):
    rows = sharding.shard_documents(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(j, ())) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return rows


def test_laws_hold(spark, sf):
    docs = table(spark, sf, "documents")
    assert len(laws(docs, 24)) == docs.count()
    laws(docs.repartition(7), 5)


def test_odd_rows(odd, empty):
    laws(odd, 4)
    laws(odd, 24)
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shuffled(odd, 3).count() == odd.count()


def test_buckets_leave_no_gap(spark, sf, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    laws(table(spark, sf, "documents"), 5)


def test_order_is_shuffled(spark, sf):
    rows = sharding.shuffled(table(spark, sf, "documents"), 2).where("shard = 0").orderBy("slot").select("doc_id").collect()
    ids = [r.doc_id for r in rows]
    n = len(ids)
    up = sum(a < b for a, b in zip(ids, ids[1:]))
    assert abs(up - n / 2) < 4 * (n / 12) ** 0.5
    assert abs(sum(ids) / n - 499.5) < 4 * 289 / n**0.5


def test_draws_have_the_right_mean_and_spread():
    rng = random.Random(1)
    for good, bad, draws in ((10, 30, 8), (500, 700, 300), (2, 100, 50), (10**7, 9 * 10**7, 5000), (4 * 10**9, 10**11, 3 * 10**7)):
        x = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)]
        p, total = good / (good + bad), good + bad
        var = draws * p * (1 - p) * (total - draws) / (total - 1)
        mean = sum(x) / len(x)
        assert abs(mean - draws * p) < 5 * (var / len(x)) ** 0.5
        assert 0.85 * var < sum((v - mean) ** 2 for v in x) / len(x) < 1.15 * var


def test_matrix_sums():
    counts = [5, 0, 17, 100, 1]
    m = sharding.matrix(counts, 6, 3)
    assert [sum(r) for r in m] == counts
    cols = [sum(c) for c in zip(*m)]
    assert max(cols) - min(cols) <= 1 and min(min(r) for r in m) >= 0


def test_native_plan(spark, sf):
    plan = sharding.shard_documents(table(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clashing_names(spark):
    rows = spark.createDataFrame([(i, f"t{i}", i, i, i, i) for i in range(30)], "doc_id long, text string, _source int, _pos int, crc int, row int")
    got = sharding.shuffled(rows, 4)
    assert got.columns == [*rows.columns, "shard", "slot"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(map(tuple, rows.collect()))
