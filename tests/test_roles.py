"""Roles of features, and scans that read their columns only."""

import re

from pyspark.sql import functions as F

from stratagrid.plans.registry import QUERIES
from stratagrid.plans.roles import MADE, written
from stratagrid.sources import roles as ro


def test_roles_by_name():
    assert "pf30_roles" in QUERIES
    assert all(ro.role(n) == r for n, (r, _) in MADE.items() if r)
    assert [ro.role(n) for n in ("entity", "date", "size_proxy", "closest", "enclose", "roe", "ann_count", "high0", "ma", "ma_5")] == ["key", "key", "meta", "past_known", "past_observed", "past_known", "past_observed", "past_known", "past_observed", "past_known"]
    assert len(set(ro.KNOWN_BY)) == len(ro.KNOWN_BY)


def test_scans_read_their_columns_and_ranges(spark):
    path = written(spark, "/root/testdata/sf0.001")
    for role in ("past_known", "past_observed", "withheld", "meta"):
        df = ro.scan(spark, path, role, start="1997-01-01", end="1998-12-31", entities=[1, 2])
        want = [n for n, (r, _) in MADE.items() if r == role]
        assert df.columns == ["entity", "date", *want]
        leaf = df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
        assert sorted(leaf.requiredSchema().fieldNames()) == sorted(["entity", "date", *want])
        pushed = leaf.dataFilters().toString()
        assert re.search(r"date#\d+ >= ", pushed) and re.search(r"date#\d+ <= ", pushed) and re.search(r"entity#\d+L? IN", pushed)
    both = ro.scan(spark, path, "past_known", "past_observed").columns
    assert not {"close", "close_lag1", "topic_entropy", "margin_balance", "sector_code"} & set(both)
    assert ro.scan(spark, path, "static").columns == ["entity", "date"]


def test_a_feature_written_later_is_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "entity int, ma_5 double, odd double").withColumn("date", F.lit("2020-01-01").cast("date"))
    path = str(tmp_path / "store")
    ro.save(df, path)
    df.withColumn("ma_9", F.lit(1.0)).write.mode("append").parquet(f"{path}/features")
    assert ro.listed(spark, path, "past_known") == ["ma_5"] and ro.scan(spark, path, "past_known", "past_observed").count() == 2
    empty = str(tmp_path / "empty")
    ro.save(df.where("false"), empty)
    assert ro.scan(spark, empty, "past_known").count() == 0
