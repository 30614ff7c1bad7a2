"""Walk-backward folds against a loop over numbered sessions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import folds as fo

DAY = datetime.date(2020, 1, 1)


def calendar(spark, n):
    return spark.createDataFrame([(DAY + datetime.timedelta(days=2 * i),) for i in range(n)], "date date")


def looped(n, s):
    out, fold, start = [], 0, n - s.horizon - s.val - s.lockbox
    while start >= 0 and (s.most is None or fold < s.most):
        train = start - s.purge
        inner = max(1, round(0.15 * (train - s.seq)))
        if train < s.seq + 1 or train - inner - s.seq < s.seq + 1:
            break
        fold += 1
        out.append((fold, train - inner - s.seq, train, start, start + s.val))
        start -= s.step
    return out


@pytest.mark.parametrize("n", [0, 1, 30, 90, 131, 400])
@pytest.mark.parametrize("shape", [fo.Shape(5, 10, 3, 20), fo.Shape(4, 6, 0, 0, step=7, purge=2, most=3), fo.Shape(10, 30, 5, 50, purge=0), fo.Shape(60, 126)])
def test_same_folds_as_a_loop(spark, n, shape):
    got = fo.walk_backward(fo.numbered(calendar(spark, n)), shape).orderBy("fold").collect()
    assert [(r.fold, r.inner_end, r.train_end, r.val_start, r.val_end) for r in got] == looped(n, shape)


def test_nothing_of_training_lies_near_its_validation(spark):
    shape = fo.Shape(5, 10, 3, 20)
    sessions = fo.numbered(calendar(spark, 150))
    plan = fo.walk_backward(sessions, shape)
    rows = fo.sliced(sessions, plan, shape).collect()
    lockbox = 150 - shape.lockbox
    for fold in {r.fold for r in rows}:
        of = lambda role, *parts: [r.i for r in rows if r.fold == fold and r.role == role and r.part in parts]  # noqa: E731,B023
        train, inner, test = of("inner_train", "context", "target"), of("inner_val", "target"), of("outer_test", "target")
        assert max(train) < min(inner) - shape.seq + 1 and max(inner) < min(test) - shape.purge + 1
        assert max(test) + shape.horizon < lockbox and max(of("outer_test", "pad")) < lockbox  # settled before the lockbox
        for role in ("inner_train", "inner_val", "outer_test"):
            every = sorted(r.local for r in rows if r.fold == fold and r.role == role)
            assert every == list(range(len(every)))
            assert sorted(r.local for r in rows if r.fold == fold and r.role == role and r.part == "context") == list(range(shape.seq))
    tests = sorted(r.i for r in rows if r.role == "outer_test" and r.part == "target")
    assert len(tests) == len(set(tests))  # no overlap


def test_an_entity_is_judged_by_its_past_only(spark):
    shape = fo.Shape(5, 10, 3, 20)
    sessions = fo.numbered(calendar(spark, 150))
    plan = fo.walk_backward(sessions, shape)
    dates = [r.date for r in sessions.orderBy("i").collect()]
    rng = np.random.default_rng(2)
    paths = {k: (100 * np.exp(np.cumsum(0.01 * rng.normal(size=150)))).tolist() for k in range(6)}
    paths[1][100] *= 40  # broken from session 100 on
    paths[2] = [None if i % 2 else v * (1 + 30 * (i > 90)) for i, v in enumerate(paths[2])]  # no neighbours, no moves over 5 sessions
    paths[3] = [None] * 60 + paths[3][60:]
    paths[4] = [None] * 150
    paths[5] = [float("nan")] + paths[5][1:]
    df = spark.createDataFrame([(k, d, v) for k, p in paths.items() for d, v in zip(dates, p, strict=True)], "entity long, date date, close double").repartition(5)
    got = {(r.entity, r.fold): r.reason for r in fo.quality(df, sessions, plan).collect()}
    ends = {r.fold: r.train_end for r in plan.collect()}

    def judged(path):
        x = np.array([np.nan if v is None else v for v in path])
        if not len(x) or np.isnan(x).all():
            return "all_nan"
        r = np.diff(x) / (x[:-1] + 1e-8)
        if not np.isnan(r).all() and np.nanstd(r) > 0.5:
            return "hi_vol"
        m = np.abs((x[5:] - x[:-5]) / (x[:-5] + 1e-8))
        return "extreme_fwd" if len(m) and not np.isnan(m).all() and np.nanmax(m) > 10 else None

    assert got == {(k, f): judged(p[:end]) for k, p in paths.items() for f, end in ends.items()}
    assert {got[1, f] for f in ends} == {None, "hi_vol"}
    kept = {r.fold: r.entities for r in fo.usable(fo.quality(df, sessions, plan), 5).collect()}
    assert all(n == sum(got[k, f] is None for k in paths) >= 5 for f, n in kept.items()) and 0 < len(kept) < len(ends)


def test_gates_add_up_and_unknown_passes_nothing(spark):
    df = spark.createDataFrame([(1, True, 5), (2, False, 5), (3, None, 1), (4, True, None), (5, False, 1)], "k int, a boolean, b int")
    gates = {"first": F.col("a"), "second": F.col("b") > 2}
    rows = {r.k: (r.reason, r.ok) for r in fo.gated(df.withColumn("ok", fo.passed(*gates.values())), gates).collect()}
    assert rows == {1: (None, True), 2: ("first", False), 3: ("first", False), 4: ("second", False), 5: ("first", False)}


def test_delisting_sessions(spark):
    shape = fo.Shape(5, 10, 3, 20)
    sessions = fo.numbered(calendar(spark, 150))
    plan = fo.walk_backward(sessions, shape)
    dates = [r.date for r in sessions.orderBy("i").collect()]
    days = {1: dates[119], 2: dates[118] + datetime.timedelta(days=1), 3: DAY - datetime.timedelta(days=9), 4: dates[-1] + datetime.timedelta(days=400), 5: None, 6: dates[129]}
    status = spark.createDataFrame(list(days.items()), "entity int, delisted date")
    got = {(r.entity, r.fold): r.forced for r in fo.delist_index(status, sessions, plan, shape).collect()}
    for fold, start in {r.fold: r.val_start for r in plan.collect()}.items():
        for k, d in days.items():
            i = -1 if d is None or d < dates[0] else sum(x <= d for x in dates) - 1
            assert got[k, fold] == (i - start if 0 <= i - start < shape.val + shape.horizon and i >= 0 else -1)


def test_wrong_shapes():
    with pytest.raises(ValueError):
        fo.Shape(seq=0)
    with pytest.raises(ValueError):
        fo.Shape(purge=-1)
