import datetime
import math
import random

from pyspark.sql import functions as F

from stratagrid.functions import rolling
from stratagrid.functions.rolling import last, quantile, rolled
from stratagrid.operators import series, technical
from stratagrid.plans import registry  # noqa: F401
from stratagrid.plans import chains


def rows(spark, odd=True):
    rng, out = random.Random(3), []
    for e, n in ((1, 90), (2, 1), (3, 40), (None, 5)):
        for i in range(n):
            x = 5.0 if e == 3 and i < 20 else rng.choice([None, rng.uniform(-3, 3), 1.0, float("nan") if odd and e == 1 and i > 60 else 2.0])
            out.append((e, datetime.date(2024, 1, 1) + datetime.timedelta(i), x, float(i % 7), i + 1.0))
    rng.shuffle(out)
    return spark.createDataFrame(out, "entity long, date date, x double, y double, rn double").repartition(3)


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-9 * max(1, abs(a))))


AGGREGATES = [F.count, F.sum, F.avg, F.min, F.max, F.stddev_samp, F.stddev_pop, F.skewness, F.kurtosis, quantile(0.8)]


def test_passes_are_window_expressions(spark, monkeypatch):
    monkeypatch.setattr(rolling, "CELLS", 64)  # several blocks an entity
    build = lambda: {f"o{i}_{d}": last(f, d, "x") for i, f in enumerate(AGGREGATES) for d in (4,)} | {f"r{i}": last(f, 10, "x", "rn") for i, f in enumerate((F.regr_slope, F.regr_intercept))} | {"all": last(F.count, 10, F.lit(1))}
    df = rows(spark)
    one, two = ({(r.entity, r.date): r for r in d.collect()} for d in (rolled(df, build), df.withColumns(build())))
    assert one.keys() == two.keys() and len(one) == 136
    for k in one:
        for n in build():
            assert same(one[k][n], two[k][n]), (k, n, one[k][n], two[k][n])


def test_the_pass_of_ranks_and_places(spark):
    df = rows(spark, False).withColumns({c: F.coalesce("x", F.lit(0.5)) + F.col("y") for c in ("close", "high", "low")})
    build = lambda: technical.position(5) | technical.extremes(5)
    df = df.withColumns({"tp": F.col("close"), "lv": F.col("y"), "ret": F.col("x"), "lvr": F.col("y")})
    one, two = ({(r.entity, r.date): r for r in d.collect()} for d in (rolled(df, build), df.withColumns(build())))
    assert all(same(one[k][n], two[k][n]) for k in one for n in build())


def test_robust_steps_hold_no_list_a_row(spark):
    for step in (series.outlier_clip, series.robust_scale):
        plan = step(rows(spark), "x")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "collect_list" not in plan and "percentile" not in plan


def test_clip_is_the_median_and_its_deviation(spark):
    df = rows(spark, False)
    got = {(r.entity, r.date): (r.x, r.x_clip) for r in series.outlier_clip(df, "x", k=1.0, d=12, least=3).collect()}
    by = {}
    for (e, d), (x, _) in got.items():
        by.setdefault(e, []).append((d, x))
    mid = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    for e, held in by.items():
        held.sort()
        for i, (d, x) in enumerate(held):
            v = [y for _, y in held[max(0, i - 11) : i + 1] if y is not None]
            m = mid(v) if v else None
            far = mid([abs(y - m) for y in v]) if v else 0
            want = min(m + far, max(m - far, x)) if x is not None and len(v) >= 3 and far > 1e-12 else x
            assert same(got[e, d][1], want)


def test_rows_carry_no_column_twice(spark):
    """A column of doubles is an input as it stands; casts and expressions are columns of their own."""
    df = rows(spark).withColumn("i", F.lit(2))
    plan = lambda build: rolled(df, build)._jdf.queryExecution().optimizedPlan().toString()
    assert "_x" not in plan(lambda: {"m": last(F.avg, 3, "x"), "s": last(F.max, 4, "y")})
    assert "_x" in plan(lambda: {"m": last(F.avg, 3, "i")}) and "_x" in plan(lambda: {"m": last(F.avg, 3, F.col("x") * 2)})
    got = {(r.entity, r.date): r.m for r in rolled(df, lambda: {"m": last(F.count, 3, "x"), "k": last(F.sum, 2, "i")}).collect()}
    assert got == {(r.entity, r.date): float(r.m) for r in df.withColumn("m", last(F.count, 3, "x")).collect()}
    named = df.withColumnRenamed("x", "n")
    assert sorted(r.m for r in rolled(named, lambda: {"m": last(F.count, 3, "n")}).collect()) == sorted(got.values())


def test_the_whole_chain_carries_what_is_read_later(spark):
    df = rows(spark, odd=False).select("entity", "date", "x", F.lit(1).alias("sector"), "y", F.col("rn").alias("close"), F.col("y").alias("ret"), F.col("rn").alias("volume"), F.col("rn").alias("amount"))
    out = chains.numeric_full("x").run(df)
    assert set(out.columns) == {"entity", "date", "y", "close", "ret", "volume", "amount", "neutral", "neutral_rs", *series.higher_order()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 4
