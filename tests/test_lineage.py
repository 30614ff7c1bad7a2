"""A change makes exactly its dependents stale."""

import pytest
from pyspark.sql import functions as F

from stratagrid.sources import lineage as li

DEPENDS = [
    ("mid", "a", "src", "1"), ("mid", "a", "src", "2"), ("mid", "b", "src", "2"), ("mid", "c", "src", "3"), ("mid", None, "src", None),
    ("top", "x", "mid", "a"), ("top", "y", "mid", "b"), ("top", "y", "mid", "c"), ("end", "z", "top", "y"), ("end", "n", "mid", None),
]
ROWS = [("1", 1, 0.5), ("1", 2, None), ("2", 1, 0.5), ("2", 1, 0.5), ("3", 9, float("nan")), (None, 4, 1.0)]
SETTINGS, CODE = {"mid": "s", "top": "t", "end": "e"}, {"mid": "1", "top": "1", "end": "1"}


@pytest.fixture(scope="module")
def depends(spark):
    return spark.createDataFrame(DEPENDS, "output string, partition string, input string, input_partition string")


def source(spark, rows):
    return spark.createDataFrame(rows, "p string, a int, b double")


def found(spark, depends, was, rows, settings=SETTINGS, code=CODE, gone=()):
    held = li.record(depends, li.digests(source(spark, was), "p", "src"), SETTINGS, CODE)
    for o, p in gone:
        held = held.where(~((F.col("output") == o) & F.col("partition").eqNullSafe(p)))
    first = li.changed(held, depends, li.digests(source(spark, rows).repartition(4).select("b", "p", "a"), "p", "src"), settings, code)
    return {(r.output, r.partition): r.steps for r in li.stale(depends, first).collect()}, {(r.output, r.partition, r.reason) for r in first.collect()}


def test_nothing_changed(spark, depends):
    assert found(spark, depends, ROWS, ROWS[::-1]) == ({}, set())


def test_one_partition_makes_its_dependents_stale(spark, depends):
    stale, why = found(spark, depends, ROWS, [*ROWS[:4], ("3", 9, 1.0), ROWS[5]])
    assert stale == {("mid", "c"): 0, ("top", "y"): 1, ("end", "z"): 2} and why == {("mid", "c", "source")}
    stale, _ = found(spark, depends, ROWS, [*ROWS[:2], ROWS[2], *ROWS[4:]])  # one of two equal rows went
    assert stale == {("mid", "a"): 0, ("mid", "b"): 0, ("top", "x"): 1, ("top", "y"): 1, ("end", "z"): 2}
    stale, _ = found(spark, depends, ROWS, [*ROWS[:5], (None, 5, 1.0)])  # the null partition
    assert stale == {("mid", None): 0, ("end", "n"): 1}


def test_gone_new_settings_code_and_missing(spark, depends):
    assert found(spark, depends, ROWS, [*ROWS[:4], ROWS[5]])[1] == {("mid", "c", "source")}
    assert found(spark, depends, [*ROWS[:4], ROWS[5]], ROWS)[1] == {("mid", "c", "source")}
    stale, why = found(spark, depends, ROWS, ROWS, SETTINGS | {"top": "new"}, CODE | {"end": "2"})
    assert why == {("top", "x", "config"), ("top", "y", "config"), ("end", "z", "code"), ("end", "n", "code")} and set(stale.values()) == {0}
    stale, why = found(spark, depends, ROWS, ROWS, gone=[("mid", "b"), ("mid", None)])
    assert why == {("mid", "b", "missing"), ("mid", None, "missing")} and stale == {("mid", "b"): 0, ("mid", None): 0, ("top", "y"): 1, ("end", "z"): 2, ("end", "n"): 1}


def test_a_dependency_that_went_or_came(spark, depends):
    now = li.digests(source(spark, ROWS), "p", "src")
    held = li.record(depends.where("not (output = 'mid' and partition <=> 'a' and input_partition <=> '2')"), now, SETTINGS, CODE)
    assert {(r.output, r.partition, r.reason) for r in li.changed(held, depends, now, SETTINGS, CODE).collect()} == {("mid", "a", "source")}


def test_circles_end(spark):
    ring = spark.createDataFrame([("a", "1", "b", "1"), ("b", "1", "a", "1"), ("c", "1", "b", "1")], "output string, partition string, input string, input_partition string")
    first = spark.createDataFrame([("a", "1")], "output string, partition string")
    assert {r.output: r.steps for r in li.stale(ring, first).collect()} == {"a": 0, "b": 1, "c": 2}
    assert li.stale(ring, first.limit(0)).count() == 0


def test_hashes(spark):
    assert li.hash_of_settings({"a": 1, "b": [2]}) == li.hash_of_settings({"b": [2], "a": 1}) != li.hash_of_settings({"a": 1, "b": [3]})
    assert li.hash_of_code(li.record) != li.hash_of_code(li.stale)
    empty = li.digests(source(spark, []), "p", "src")
    assert empty.count() == 0
    other = source(spark, ROWS).withColumn("a", F.col("a").cast("long"))  # the schema counts
    d = lambda df: {r.input_partition: r.digest for r in li.digests(df, "p", "src").collect()}
    assert d(other)["1"] != d(source(spark, ROWS))["1"]
