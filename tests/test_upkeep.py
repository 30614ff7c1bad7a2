"""Upkeep on odd rows."""

import pytest
from pyspark.sql import functions as F

from stratagrid.operators import upkeep as u


def test_tail_closes_the_open_interval_and_skips_what_is_known(spark):
    held = spark.createDataFrame([(1, 7, "2020-01-01", None), (2, 8, "2020-01-01", "2020-02-01")], "entity int, v int, in_date string, out_date string")
    tail = spark.createDataFrame([(1, "2020-01-01", 9), (1, "2020-03-01", None), (1, "2020-04-01", 5), (3, "2020-05-01", 6)], "entity int, date string, v int")
    got = {tuple(r) for r in u.extended(held, tail, "v").collect()}
    assert got == {(1, 7, "2020-01-01", "2020-03-01"), (1, 5, "2020-04-01", None), (2, 8, "2020-01-01", "2020-02-01"), (3, 6, "2020-05-01", None)}
    assert u.extended(held, tail.limit(0), "v").count() == 2


def test_null_prices_stay_and_sums_add_up(spark):
    rows = spark.createDataFrame([(1, "a", -1.0), (1, "b", None), (2, "a", 0.001)], "entity int, date string, x double")
    assert [r.x for r in u.lifted(rows, ["x"]).orderBy("entity", "date").collect()] == [0.01, None, 0.001]
    halves = [u.date_sums(rows.where(F.col("entity") == e), ["x"]) for e in (1, 2)]
    got = u.date_statistics(u.added_up(halves)).collect()
    assert [(r.date, r.n) for r in got] == [("a", 2)]


def test_unknown_channels_are_not_admitted(spark):
    d = spark.createDataFrame([("c", None, "none", "verified")], "channel string, source_vintage string, transform string, pit_alignment string")
    assert d.where(u.admitted("allow_revised", ["none"])).count() == 0
    with pytest.raises(ValueError):
        u.admitted("other", [])
