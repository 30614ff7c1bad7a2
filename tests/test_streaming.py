"""Streams over tables of several files, which are not written in order of time."""

import datetime
import os

import pytest

from stratagrid.plans.registry import ORACLES, QUERIES
from tests.oracle import differences

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def several(spark, tmp_path_factory):
    """Eight files of three days each, the latest days in the first file."""
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, START + datetime.timedelta(hours=0.1 * i), i % 7, "click" if i % 3 else "view", i % 11 / 4, "{}") for i in range(5760)]
    for k in range(8):
        part = rows[(7 - k) * 720 : (8 - k) * 720]
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{folder}/events.parquet")) == 8
    return str(folder)


@pytest.mark.parametrize("name", [n for n in sorted(ORACLES) if n.startswith("st0")])
def test_no_row_is_late(spark, several, name):
    sql = ORACLES[name].replace("FROM events", f"FROM '{several}/events.parquet/*.parquet'")
    assert differences(spark, several, QUERIES[name], sql) == []
