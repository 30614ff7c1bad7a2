"""Corrupted copies are the same however rows are dealt out, and as strong as asked."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import corruption as co

DAY = datetime.date(2021, 1, 1)
SCHEMA = "entity int, date date, x double, y double, key string, d string"


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(k, DAY + datetime.timedelta(days=i), float(k), None if i == 3 else 1.0, "k", "d") for k in range(100) for i in range(30)]
    return spark.createDataFrame([*rows, (1, None, 5.0, 5.0, "k", "d"), (None, DAY, 5.0, 5.0, "k", "d")], SCHEMA)


def held(df):
    return sorted(map(str, df.collect()))


def test_the_same_on_any_number_of_partitions(panel):
    of = lambda n: held(co.corrupted(panel.repartition(n), ["x", "y"], 7, F.col("entity") % 2 == 0, 0.3, 0.9, 0.1))
    assert of(1) == of(13)
    assert of(1) != held(co.corrupted(panel, ["x", "y"], 8, F.col("entity") % 2 == 0, 0.3, 0.9, 0.1))


def test_noise_is_normal_and_on_observed_cells_only(panel):
    rows = panel.withColumnRenamed("x", "was").withColumn("x", F.col("was"))
    out = co.corrupted(rows, ["x", "y"], 3, F.col("entity") < 80, 0.5, 0.0, 0.0).where("entity is not null and date is not null").collect()
    seen = np.array([r.x - r.was for r in out if r.entity < 80])
    assert all(r.x == r.was for r in out if r.entity >= 80) and all(r.y is None for r in out if r.date == DAY + datetime.timedelta(days=3))
    assert abs(seen.mean()) < 0.05 and abs(seen.std() - 0.5) < 0.03 and abs((np.abs(seen) < 0.5).mean() - 0.683) < 0.03
    other = np.array([r.y - 1 for r in out if r.entity < 80 and r.y is not None])
    assert len(np.unique(seen)) == len(seen) and abs(np.corrcoef(seen[: len(other)], other)[0, 1]) < 0.06


def test_masks(panel):
    runs, drops = [], 0
    for seed in range(12):
        dates = sorted(r.date for r in co.masked_dates(panel, seed, 0.5).collect())
        runs.append(len(dates))
        assert not dates or (dates[-1] - dates[0]).days == len(dates) - 1 and len(dates) <= co.LONGEST
    assert 0 in runs and max(runs) > 1
    always = co.corrupted(panel, ["x", "y"], 1, None, 0.0, 1.0, 0.0)
    hidden = {r.date for r in co.masked_dates(panel, 1, 1.0).collect()}
    assert {r.date for r in always.where("entity > 0").collect() if r.x == 0} == hidden and len(hidden) >= 1
    assert all(r.x == 0 and r.y == 0 and r.key == "k" for r in co.corrupted(panel, ["x", "y"], 1, dropout=1.0).collect())
    two = panel.where(F.col("date") < DAY + datetime.timedelta(days=2))
    assert co.masked_dates(two, 1, 1.0).count() == 0 and co.corrupted(panel.where("false"), ["x"], 1).count() == 0


def test_no_exchange_of_the_rows(panel):
    plan = co.corrupted(panel, ["x", "y"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0] and "Python" not in plan
