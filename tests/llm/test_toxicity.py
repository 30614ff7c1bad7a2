from stratagrid.llm import toxicity
from stratagrid.session import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    said, true = sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    assert hit / said > 0.9 and hit / true > 0.6, (hit, said, true)


def test_odd_rows(spark, sf, odd, empty):
    labels = table(spark, sf, "labels")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) for r in rows)
    assert toxicity.score(empty, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}


def test_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("You are an 1d1ot, a LOSER!! fine words here".encode(), {"fine": 0.5})))
    assert f["lexicon_count"] == 2 and f["stem_count"] == 1 and f["near"] > 0 and f["odd"] > 0 and f["exclaims"] > 0
    assert toxicity.features_of(b"", {}) == (0.0,) * len(toxicity.FEATURES)
