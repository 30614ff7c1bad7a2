"""Two writers of one store."""

import threading

import pytest

from stratagrid.sources import store

SCHEMA = "entity int, date int, x int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(spark, root):
    return sorted(tuple(r) for r in store.read_version(spark, root).select("entity", "date", "x").collect())


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    start, failed = threading.Barrier(4), []

    def write(k):
        try:
            start.wait()
            store.upsert(rows(spark, (k, 1, k), (9, 9, k)), root, ["entity", "date"])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = held(spark, root)
    assert [r for r in got if r[0] < 9] == [(k, 1, k) for k in range(4)] and len(got) == 5


def test_a_second_version_after_the_same_one_is_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.write_version(rows(spark, (1, 1, 1)), root, None) == 1
    assert store.write_version(rows(spark, (1, 1, 2)), root, 1) == 2
    with pytest.raises(store.Conflict):
        store.write_version(rows(spark, (1, 1, 3)), root, 1)
    assert held(spark, root) == [(1, 1, 2)]
    assert store.upsert(rows(spark, (2, 1, 5)), root, ["entity", "date"]) == 4  # the refused one's number stays used
    assert held(spark, root) == [(1, 1, 2), (2, 1, 5)]


def test_a_dead_writer_is_named(spark, tmp_path):
    root = str(tmp_path / "store")
    store.write_version(rows(spark, (1, 1, 1)), root, None)
    assert store._claimed(spark, f"{root}/claims/after{1:08d}")  # and then nothing
    with pytest.raises(store.Conflict, match="after 1"):
        store.upsert(rows(spark, (1, 1, 2)), root, ["entity", "date"], tries=2, wait=0.1)
    assert held(spark, root) == [(1, 1, 1)]
