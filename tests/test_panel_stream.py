"""Streams over several micro-batches: late rows, timers, and a panel whose sums are kept in step."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratagrid.plans.registry import ORACLES, QUERIES
from stratagrid.plans.streaming import in_slices
from stratagrid.streaming import events as ev
from stratagrid.streaming.panel import Panel, fed
from tests.oracle import differences

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string, slice int"


def events(spark, rows):
    """(id, hour, user, slice)"""
    return spark.createDataFrame([(i, START + datetime.timedelta(hours=h), u, "click", 1.0, "{}", s) for i, h, u, s in rows], SCHEMA)


def test_late_rows_are_what_tells_stream_and_batch_apart(spark, sf):
    for name in ("st06_closed_windows", "st07_late_rows", "st08_idle_spells"):
        assert differences(spark, sf, QUERIES[name], ORACLES[name]) == []
    late = QUERIES["st07_late_rows"](spark, sf).agg(F.sum("late").alias("late"), F.sum("n").alias("n")).first()
    assert 0 < late.late < late.n / 4


def test_a_row_at_the_watermark_is_late(spark):
    rows = [(1, 0, 7, 0), (2, 30, 7, 0), (3, 5.5, 7, 1), (4, 6, 7, 1), (5, 6.5, 7, 1), (2, 30, 7, 1), (6, 90, 7, 2)]  # the watermark after slice 0: hour 6
    out, seen = in_slices(spark, events(spark, rows), 3, lambda e: ev.on_time(e, late="1 day"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 5, 6]
    dropped = pd.DataFrame(seen, columns=["slice", "n", "late"]).groupby("slice").late.sum().to_dict()
    assert dropped == {0: 0, 1: 2, 2: 0}  # the repeated id is no late row


def test_windows_come_out_once_when_they_are_closed(spark):
    rows = [(1, 1, 1, 0), (2, 2, 2, 0), (3, 25, 1, 0), (4, 3, 1, 1), (5, 60, 1, 1), (6, 4, 1, 2), (7, 61, 1, 2)]
    out, _ = in_slices(spark, events(spark, rows), 3, lambda e: ev.closed_windows(e, late="1 day"))
    assert [(r.start, r.n) for r in out.orderBy("start").collect()] == [(START, 3)]  # id 6 is late, days 2 and 3 are open


def test_a_row_out_of_order_joins_two_runs(spark):
    rows = [(1, 0, 1, 0), (2, 10, 1, 0), (3, 0, 2, 0), (4, 5, 1, 1), (5, 100, 3, 1), (6, 200, 3, 2)]
    out, _ = in_slices(spark, events(spark, rows), 3, lambda e: ev.idle_spells(e, late="1 day"))
    got = sorted((r.user_id, (r.last - r.start).total_seconds() / 3600, r.n) for r in out.collect())
    assert got == [(1, 10, 3), (2, 0, 1), (3, 0, 1)]


def test_users_that_share_a_state_keep_their_own_runs(spark):
    big = 2**53
    rows = [(1, 0, 0, 0), (2, 1, None, 0), (3, 2, big, 0), (4, 3, big + 1, 0), (5, 10, 0, 0), (6, 5, 0, 1), (7, 5, None, 1), (8, 11, None, 1), (9, 100, 3, 1), (10, 200, 3, 2)]
    out, _ = in_slices(spark, events(spark, rows), 3, lambda e: ev.idle_spells(e, late="1 day", buckets=1))
    got = {(r.user_id, (r.start - START).total_seconds() / 3600, (r.last - START).total_seconds() / 3600, r.n, r.total) for r in out.collect()}
    assert got == {(0, 0, 10, 3, 3.0), (None, 1, 5, 2, 2.0), (None, 11, 11, 1, 1.0), (big, 2, 2, 1, 1.0), (big + 1, 3, 3, 1, 1.0), (3, 100, 100, 1, 1.0)}


PANEL = "entity string, date int, x double, y double, batch string"


def stats(panel, spark):
    return {(r.date, r.feature): (r.n, float(r.s), float(r.q)) for r in panel.sums(spark).collect()}


@pytest.fixture
def chunks(spark):
    make = lambda rows: spark.createDataFrame([(*r, "b") for r in rows], PANEL)
    return [
        make([("a", 1, 0.1, 1.0), ("a", 2, 0.2, None), ("b", 1, 0.3, float("nan")), ("b", 1, 0.3, float("inf"))]),
        make([("c", d, d / 3, 1.0) for d in (1, 2, 3)] + [(None, 1, 9.0, 9.0), ("d", None, 9.0, 9.0)]),
        make([("a", 2, 0.7, 5.0), ("a", 3, 0.1, None)]),
        make([]),
        make([("b", 4, -1.0, -1.0), ("a", 1, 0.1, 0.1)]),
    ]


def test_replay_and_replacement(spark, chunks, tmp_path):
    panel = Panel(str(tmp_path / "store"), ["x", "y"])
    for n, c in enumerate(chunks):
        panel.merge(c.drop("batch"), n)
    once = stats(panel, spark)
    left = pd.concat([chunks[1].toPandas().dropna(subset=["entity", "date"]), chunks[4].toPandas()])  # newest chunks of c, and of b and a
    want = {}
    for f in ("x", "y"):
        for d, v in left.groupby("date")[f]:
            v = v.astype(float).round(12)
            want[d, f] = (len(v), v.sum(), (v**2).sum())
    assert set(once) == set(want)
    assert all(a == pytest.approx(want[k], abs=1e-9) for k, a in once.items())
    for n in (4, 2, 0, 3):  # also batches that came before others
        panel.merge(chunks[n].drop("batch"), n)
        assert stats(panel, spark) == once
    assert sorted((r.entity, r.date) for r in panel.rows(spark).collect()) == sorted(zip(left.entity, left.date, strict=True))


def test_one_batch_and_many_give_the_same(spark, chunks, tmp_path):
    one, many = Panel(str(tmp_path / "one"), ["x"]), Panel(str(tmp_path / "many"), ["x"])
    for n, c in enumerate(chunks[:3]):
        many.merge(c.drop("batch"), n)
    one.merge(many.rows(spark), 0)
    assert stats(one, spark) == stats(many, spark)
    key = lambda p: sorted((r.entity, r.date, round(r.z, 9)) for r in p.scored(spark).collect())
    assert key(one) == key(many)


def test_a_stream_feeds_it(spark, chunks, tmp_path):
    rows = chunks[0].drop("batch")
    rows.where("false").write.parquet(str(tmp_path / "in"))
    panel = Panel(str(tmp_path / "store"), ["x", "y"])
    run = fed(spark, panel, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    for c in chunks[:3]:
        c.drop("batch").write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()  # nothing new
    direct = Panel(str(tmp_path / "direct"), ["x", "y"])
    for n, c in enumerate(chunks[:3]):
        direct.merge(c.drop("batch"), n)
    assert stats(panel, spark) == stats(direct, spark)
