import numpy as np
from pyspark.sql import functions as F

from stratagrid.llm import mixing
from stratagrid.session import table


def test_targets_are_met(spark, sf):
    got = mixing.rates(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas()
    assert len(got) == 1000 and (got.rate >= 0).all()
    total = got.tokens.sum()
    for k, v in mixing.TARGETS.items():
        assert abs((got.tokens * got[f"p_{k}"] * got.rate).sum() / total - v) < 2e-3
    assert np.allclose(got[["p_good", "p_low", "p_toxic"]].sum(axis=1), 1)
    assert ((got.copies - got.rate).abs() < 1).all()


def test_same_as_numpy(spark, sf):
    """The rates are those of projected gradient steps on the whole vector, and the residual is that of all documents."""
    members, pulls, residual, _ = mixing.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = members.withColumn("rate", mixing.rate(pulls)).drop("row").toPandas()
    p = rows[["p_good", "p_low", "p_toxic"]].to_numpy()
    w = rows.tokens.to_numpy(float)
    goal, m = np.array([mixing.TARGETS[k] for k in ("good", "low", "toxic")]), (w[:, None] * p).sum(0) / w.sum()
    x, s = np.ones(len(w)), 1 / (1 + mixing.RIDGE)
    for pull in pulls:  # the residuals of a step are those of the rows it was taken on: the summary's or the documents'
        x = np.maximum(0, x - s * mixing.RIDGE * (x - 1) - p @ np.array([pull[k] for k in ("good", "low", "toxic")]))
    assert np.allclose(x, rows.rate, atol=1e-6)
    r = (x * w) @ p / w.sum() - goal
    assert np.allclose(r, [residual[k] for k in ("good", "low", "toxic")], atol=1e-9) and np.abs(r).max() <= mixing.CLOSE
    # no other nonnegative rates are nearer: every rate obeys the optimality conditions of the fitted problem
    g = p @ (r / m) + mixing.RIDGE * (x - 1)
    assert g[x == 0].min(initial=0) > -1e-2 and np.abs(g[x > 0]).max() < 1e-2
    first = {k: v for k, v in zip(("good", "low", "toxic"), (w @ p / w.sum() - goal) / m / (1 + mixing.RIDGE))}
    assert all(abs(pulls[0][k] - v) < 1e-3 for k, v in first.items())  # the summary's first step is the documents'


def test_plan_reads_stored_numbers(spark, sf):
    """No text is parsed again for the rates, and the plan doesn't grow with the steps."""
    plan = mixing.mixed(table(spark, sf, "documents"), table(spark, sf, "labels"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "translate" not in plan
    assert plan.count("EXP(") < 100 and len(plan) < 60_000


def test_documents_repeat_as_often_as_their_copies(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    want = {r.doc_id: r.copies for r in mixing.rates(docs, labels).collect()}
    out = mixing.mixed(docs, labels)
    assert out.columns == docs.columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_odd_rows(spark, sf, odd, empty):
    labels = table(spark, sf, "labels")
    assert mixing.rates(odd, labels).count() == odd.count()
    assert mixing.rates(odd, labels.limit(0)).agg(F.min("rate"), F.max("rate")).first() == (1.0, 1.0)
    assert mixing.rates(empty, labels).count() == 0 and mixing.mixed(empty, labels).count() == 0
    assert mixing.mixed(odd, labels).columns == odd.columns
    assert mixing.mixed(odd, labels.limit(0)).count() == odd.count()


def test_native_plan(spark, sf):
    plan = mixing.rates(table(spark, sf, "documents"), table(spark, sf, "labels"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
