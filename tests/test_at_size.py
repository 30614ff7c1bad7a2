"""Steps whose work would grow faster than their rows, and odd values they must keep."""

import datetime
import math
import random
import struct

import duckdb
from pyspark.sql import functions as F

from stratagrid import session
from stratagrid.operators import account, aggregates, cross_section, series, text, units
from stratagrid.plans import registry
from stratagrid.sources import store

DAY = datetime.date(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_a_move_from_zero_is_infinite(spark):
    days = {1: [0.0, 2.0], 2: [0.0, -1.0, 5.0], 3: [0.0, 0.0], 4: [0.0], 5: [2.0, 3.0], 6: [None, 1.0], 7: [0.0, None]}
    rows = [(100 * e + i, datetime.datetime(2024, 1, 1, 10, i), e, v) for e, vs in days.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, entity long, value double")
    got = {r.entity: r.opening_move for r in series.intraday(df).collect()}
    assert got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3]) and got[5] == 0.5
    assert got[4] is None and got[6] is None and got[7] is None


def test_exits_are_found_by_frames_that_grow(spark):
    df = spark.createDataFrame([(1, DAY, 1.0, 1.0, 1.0)], "entity int, date date, open double, close double, score double")
    assert "6, unboundedfollowing" not in plan(account.orders(df, "score", 0.5, 5))


def test_exit_is_the_first_open_after_the_horizon(spark):
    opens = [1.0, 2.0, 3.0, None, None, 6.0, None, 8.0]
    df = spark.createDataFrame([(1, DAY + datetime.timedelta(i), o, o, 1.0) for i, o in enumerate(opens)], "entity int, date date, open double, close double, score double")
    got = {(r.decided - DAY).days: (r.sold and (r.sold - DAY).days, r.leave, r.outcome) for r in account.orders(df, "score", 1.0, 2).collect()}
    assert got == {0: (5, 6.0, "delayed"), 1: (5, 6.0, "delayed"), 4: (7, 8.0, "sold"), 6: (None, 8.0, "unresolved")}


def test_quantiles_without_a_map_of_all_values(spark):
    rng = random.Random(5)
    shares = [0, 0.1, 0.25, 0.5, 0.77, 0.9, 1]
    for values in ([rng.choice([rng.uniform(0, 1), 0.5, None]) for _ in range(997)], [3.0], [None], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
        want = df.agg(F.percentile("v", F.array(*(F.lit(float(p)) for p in shares)))).first()[0] or []
        got = aggregates.quantiles(df, "v", shares).first().e
        assert len(got) == len(want) and all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))
    assert " percentile(" not in plan(aggregates.quantiles(df, "v", shares)) and "[percentile(" not in plan(aggregates.quantiles(df, "v", shares))


def test_distances_stop_where_no_pair_can_be(spark):
    texts = ["a" * 40, "a" * 37 + "bcd", "a" * 36 + "bcde", "A" * 40, "a" * 39]
    df = spark.createDataFrame([(1, DAY, k, t) for k, t in enumerate(texts)], "entity int, date date, k int, t string")
    found = text.near_pairs(df, "t", "k")
    assert {(r.later, r.earlier): r.similarity for r in found.collect()} == {(1, 0): 0.925, (2, 1): 0.95, (3, 0): 1.0, (3, 1): 0.925, (4, 0): 0.975, (4, 1): 0.925, (4, 3): 0.975}
    assert "ceil" in plan(found)


def test_the_grid_unfolds_in_tasks_of_bounded_size(spark, monkeypatch):
    """Tasks grow in number with the grid, none of which is shuffled; gaps, late starts, rows of no entity and repeated rows are as ever."""
    monkeypatch.setattr(series, "GRID_ROWS", 10)
    days = [DAY + datetime.timedelta(i) for i in (0, 1, 3, 4, 7)]
    held = [(e, d, float(10 * e + i)) for e in range(40) for i, d in enumerate(days) if e == 0 or (i + e) % 3]
    df = spark.createDataFrame([*held, (None, days[3], 5.0), (0, days[1], -1.0), (3, None, 7.0)], "entity int, date date, close double")
    grid = series.grid(df)
    assert grid.columns == ["entity", "date", "close"]
    of = {}
    for e, d, v in held:
        of.setdefault(e, {})[d] = v
    want = [(e, d, at.get(d)) for e, at in of.items() for d in days if d >= min(at)] + [(0, days[1], -1.0), (None, days[3], None), (None, days[4], None)]
    assert sorted(map(str, (tuple(r) for r in grid.collect()))) == sorted(map(str, want))
    sizes = grid.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 20 and max(sizes) < len(want) / 3
    assert "sortmergejoin" not in plan(grid)
    assert series.grid(df.where("false")).count() == 0


def test_rank_normal_has_two_windows_and_whole_dates(spark, sf, monkeypatch):
    """The quantile's many mentions of its share are no windows of their own; tasks follow the table's rows."""
    rows = [(e, DAY + datetime.timedelta(d), None if d == 2 or (e + d) % 5 == 0 else float(e * e % 7)) for e in range(9) for d in range(4)] + [(1, DAY + datetime.timedelta(9), 3.0)]
    df = spark.createDataFrame(rows, "entity int, date date, ret double")
    got = cross_section.with_rank_normal(df, "ret", "g")
    assert got.columns == ["entity", "date", "ret", "g"] and plan(got).count(" rank(ret") <= 2 * 2
    want = cross_section.rank_normal("ret")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("g", F.when(F.count("ret").over(cross_section.per_date()) > 0, want).otherwise(F.lit(0.0))).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    assert "hashpartitioning(date#" in plan(registry.QUERIES["cx06_rank_normal"](spark, sf)) and ", 60)" in plan(registry.QUERIES["cx06_rank_normal"](spark, sf))


def test_concepts_rank_whole_dates_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    rows = [(e, DAY + datetime.timedelta(d), "b", float((e * 7 + d) % 4)) for e in range(20) for d in range(10)]
    df = spark.createDataFrame(rows, "entity int, date date, board string, mom double")
    out = aggregates.concepts(df, "board", "mom")
    assert ", 20)" in plan(out) and plan(out).count("window [") <= 3
    for r in out.collect():
        day = [x[3] for x in rows if x[1] == r.date]
        mine = next(x[3] for x in rows if x[1] == r.date and x[0] == r.entity)
        pct = (sum(v < mine for v in day) + (day.count(mine) + 1) / 2) / len(day)
        assert abs(r.heat - pct) < 1e-12 and r.boards == 1 and r.max_mom == mine and r.hot == (pct > 0.9)


def test_compaction_makes_more_files_of_more_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    df = spark.createDataFrame([(e, DAY + datetime.timedelta(d), float(d)) for e in range(20) for d in range(10)], "entity int, date date, volume double").repartition(3)
    store.compact(df, str(tmp_path / "big"), 4)
    assert len(list((tmp_path / "big").glob("*.parquet"))) >= 15 and spark.read.parquet(str(tmp_path / "big")).exceptAll(df).count() == 0
    store.compact(df.limit(8), str(tmp_path / "few"), 4)
    assert len(list((tmp_path / "few").glob("*.parquet"))) <= 4


def test_unit_medians_keep_no_map_of_a_group(spark):
    rng = random.Random(4)
    held = [(e, 1990 + y, rng.choice([1.0, 2.0, rng.uniform(0, 200)])) for e in range(6) for y in range(4) for _ in range(1 + (e * y) % 7)]
    rows = spark.createDataFrame([*held, (None, 1990, 3.0)], "entity int, year long, ratio double")
    want = rows.groupBy("entity", "year").agg(F.median("ratio").alias("median"), F.count("*").alias("n"))
    assert sorted(map(str, units.medians(rows, "entity", "year").collect())) == sorted(map(str, want.collect()))
    assert "median(" not in plan(units.years(rows)) and all(r.entity is not None for r in units.years(rows).collect())


def test_a_move_from_zero_to_zero_is_the_nan_of_sql(spark):
    df = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1, 10, i), 1, v) for i, v in enumerate([0.0, 0.0, 5.0])], "event_id long, ts timestamp, entity long, value double")
    rows = series.intraday(df).select((F.round(F.col("opening_move") * 1e6) / 1e6).alias("m")).collect()
    want = duckdb.sql("SELECT round(b / a - 1, 6) FROM (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM range(1))").fetchall()[0][0]
    assert {struct.pack(">d", r.m) for r in rows} == {struct.pack(">d", want)}
