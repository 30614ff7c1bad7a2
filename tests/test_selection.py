"""Feature selection against whole-matrix forms, and on odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import selection as sel

KEY = ["entity", "date"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 1200
    x = pd.DataFrame({"entity": np.arange(n) % 40, "date": np.arange(n) // 40, "a": rng.normal(size=n), "b": np.round(rng.normal(size=n), 1), "hot": (rng.random(n) < 0.3).astype(float)})
    x["copy"] = 2 * x.a + 0.01 * rng.normal(size=n)
    x["y"] = x.a + 0.5 * x.b**2 + 0.3 * x.hot + rng.normal(size=n)
    x["flat"] = 1.0
    x.loc[rng.random(n) < 0.1, "b"] = np.nan
    x["k"] = pd.cut(x.y, [-99, -0.5, 1, 99], labels=False)
    return x


FEATURES = ["a", "b", "copy", "flat", "hot"]


def test_mutual_information_is_of_the_joint_histogram(spark, frame):
    got = {r.feature: r for r in sel.mutual_information(spark.createDataFrame(frame).repartition(7), FEATURES, "k").collect()}
    for f in FEATURES:
        held = frame[[f, "k"]].dropna()
        bins = np.floor((held[f].rank(method="min") - 1) * 10 / len(held)).astype(int)
        joint = pd.crosstab(bins, held.k).to_numpy() / len(held)
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        want = (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
        assert got[f].n == len(held) and got[f].mi == pytest.approx(max(want, 0), abs=1e-12)
    assert got["flat"].mi == 0 and got["a"].mi > got["hot"].mi


def test_forward_equals_least_squares_each_time(spark, frame):
    held = frame.dropna()
    early = (held.date < 20).to_numpy()
    got = sel.forward(spark.createDataFrame(frame).repartition(5), FEATURES, "y", F.col("date") < 20, 9).collect()
    assert [r.step for r in got] == [1, 2, 3, 4]  # "flat" never

    def score(chosen):
        x = np.column_stack([np.ones(len(held)), held[chosen]])
        w = np.linalg.lstsq(x[early], held.y[early], rcond=None)[0]
        return 1 - ((held.y[~early] - x[~early] @ w) ** 2).sum() / ((held.y[~early] - held.y[early].mean()) ** 2).sum()

    chosen = []
    for r in got:
        left = [f for f in FEATURES if f not in chosen and f != "flat"]
        best = max(left, key=lambda f: (score([*chosen, f]), f))
        assert r.feature == best and r.score == pytest.approx(score([*chosen, best]), abs=1e-9)
        chosen.append(best)


def test_thinned_keeps_the_better_of_two_alike(spark, frame):
    df = spark.createDataFrame(frame).repartition(6)
    spearman = lambda f: frame[[f, "y"]].dropna().corr("spearman").iloc[0, 1]
    for r in sel.pooled_ic(df, FEATURES, "y", KEY).collect():
        assert r.ic == pytest.approx(0 if r.feature == "flat" else spearman(r.feature), abs=1e-12)
    got = {r.feature: r for r in sel.thinned(df, FEATURES, "y", KEY, least=0.0).collect()}
    better, worse = sorted(("a", "copy"), key=lambda f: -abs(spearman(f)))
    assert got[better].kept and not got[worse].kept and got["hot"].kept and "flat" not in got
    apart = sel.thinned(df, FEATURES, "y", KEY, {"a": "one", "copy": "other"}, least=0.0)
    assert all(r.kept for r in apart.collect())
    near = sel.rank_correlations(df, FEATURES, KEY)
    assert np.allclose(near, frame[FEATURES].fillna(0).corr("spearman").fillna(0).to_numpy(), atol=1e-12) or near[3, 3] == 0


def test_nothing_to_choose_from(spark):
    none = spark.createDataFrame([], "entity long, date long, a double, b double, y double, k int")
    assert [(r.feature, r.n, r.mi) for r in sel.mutual_information(none, ["a", "b"], "k").orderBy("feature").collect()] == [("a", 0, 0.0), ("b", 0, 0.0)]
    assert sel.forward(none, ["a", "b"], "y", F.col("date") < 5).count() == 0
    assert sel.thinned(none, ["a", "b"], "y", KEY).count() == 0
    odd = spark.createDataFrame([(1, 1, None, float("nan"), 1.0, 1), (2, 1, None, None, 2.0, None)], none.schema)
    assert {r.mi for r in sel.mutual_information(odd, ["a", "b"], "k").collect()} == {0.0}
    assert sel.forward(odd, ["a", "b"], "y", F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="features"):
        sel.products(none, ["a"] * 3000)


def test_ranks_need_no_join_of_rows(spark, frame, monkeypatch):
    """Rows of equal keys stay rows of their own, and blocks and ranges of any size give the same sums; half the values are one."""
    monkeypatch.setattr(sel, "BLOCK_CELLS", 700)
    x = frame.assign(entity=1, date=1, half=np.where(np.arange(len(frame)) % 2, 0.0, frame.a - 0.5), none=np.nan)
    names = [*FEATURES, "half", "none"]
    df = spark.createDataFrame(x).repartition(3)
    got = {r.feature: r for r in sel.pooled_ic(df, names, "y", KEY).collect()}
    for f in ("a", "b", "copy", "hot", "half"):
        held = x[[f, "y"]].dropna()
        assert got[f].n == len(held) and got[f].ic == pytest.approx(held.corr("spearman").iloc[0, 1], abs=1e-12)
    assert (got["none"].n, got["none"].ic, got["flat"].ic) == (0, 0.0, 0.0)
    want = x[["a", "b", "copy", "hot", "half"]].fillna(0).corr("spearman").to_numpy()
    assert np.allclose(sel.rank_correlations(df, ["a", "b", "copy", "hot", "half"], KEY), want, atol=1e-12)


def test_bins_come_from_the_ranges_that_hold_a_border(spark, frame, monkeypatch):
    """Whole values are neither grouped nor joined: of 2000 values only those near borders leave a task."""
    seen = []
    found = sel.borders
    monkeypatch.setattr(sel, "borders", lambda *a: seen.append(found(*a)) or seen[-1])
    x = np.random.default_rng(3).normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "few": np.round(x), "k": np.where(x > 0, "up", "down")})).repartition(4)
    got = {r.feature: r for r in sel.mutual_information(df, ["x", "few"], "k").collect()}
    assert list(seen[0][0]) == [np.sort(x)[200 * k - 1] for k in range(1, 10)]
    assert got["x"].n == 2000 and got["x"].mi == pytest.approx(np.log(2), abs=0.06) and 0 < got["few"].mi < got["x"].mi
