"""Filled gaps against a loop over each entity."""

import datetime
import random

from pyspark.sql import functions as F

from stratagrid.operators import series as s

DAY = datetime.date(2020, 1, 1)


def looped(values):
    out, seen, i = [], [], 0
    while i < len(values):
        if values[i] is not None:
            seen.append(values[i])
            out.append(values[i])
            i += 1
            continue
        j = i
        while j < len(values) and values[j] is None:
            j += 1
        fill = None
        if seen and j - i <= 10:
            fill = seen[-1]
            if j - i > 2 and len(seen) > 1:
                past, var = seen[-5:], 1.0
                fill = past[0]
                for v in past[1:]:
                    var += 0.1
                    fill, var = fill + var / (var + 1) * (v - fill), var / (var + 1)
        out += [fill] * (j - i)
        i = j
    return out


def test_fills_as_a_loop_does(spark):
    rng = random.Random(3)
    paths = {0: [None] * 5, 1: [None, 1.0] + [None] * 4, 2: [1.0, 2.0] + [None] * 11 + [3.0], 3: [1.0] * 3 + [None] * 10, 4: [5.0]}
    for k in range(5, 15):
        paths[k] = [v for _ in range(20) for v in [rng.uniform(1, 9)] * rng.randrange(1, 4) + [None] * rng.randrange(13)]
    rows = [(k, DAY + datetime.timedelta(days=2 * i), float("nan") if v is None and (i + k) % 3 == 0 else v, 9) for k, p in paths.items() for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "entity int, date date, x double, filled int").drop("filled").repartition(4)
    got = {(r.entity, r.date): r for r in s.imputed(df, "x").collect()}
    assert len(got) == len(rows)
    for k, p in paths.items():
        for i, (v, want) in enumerate(zip(p, looped(p), strict=True)):
            r = got[k, DAY + datetime.timedelta(days=2 * i)]
            assert r.has_gap == (v is None) and (r.filled is None) == (want is None)
            assert want is None or abs(r.filled - want) < 1e-12
    assert s.imputed(df.where("false"), "x").count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.range(10).select(F.lit(1).alias("entity"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"))
    plan = s.imputed(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_robust_scale_keeps_null(spark):
    df = spark.range(100).select(F.lit(1).alias("entity"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"))
    rows = s.robust_scale(df, "x").collect()
    assert all((r.x_rs is None) or r.x is not None for r in rows) and any(r.x_rs is not None for r in rows)
