"""Books of the best and the worst against a loop over phases."""

import math
import random

from pyspark.sql import functions as F

from stratagrid.operators.evaluation import portfolio_returns


def looped(rows, horizon, top):
    dates, out = sorted({r[1] for r in rows}), []
    for phase in range(horizon):
        for d in dates[phase::horizon]:
            held = [(-s, e, o) for e, x, s, o, p in rows if x == d and p and s is not None and o is not None and math.isfinite(s) and math.isfinite(o)]
            n = len(held)
            if n >= 2:
                k = max(1, min(n // 2, round(top * n)))
                held.sort()
                best, worst = ([h[2] for h in part] for part in (held[:k], held[-k:]))
                out.append((d, phase, n, k, sum(best) / k, sum(worst) / k))
    return out


def test_all_phases_behind_each_other(spark):
    rng = random.Random(1)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [(e, d, rng.choice([rng.random(), round(rng.random(), 1), *odd]) if d % 4 else round(rng.random(), 1), rng.choice([rng.random()] * 6 + odd), rng.choice([True, True, False, None])) for d in range(23) for e in range(1 + d % 9 * 3)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "entity int, date int, s double, o double, p boolean, n string").repartition(5)
    for horizon, top in ((1, 0.1), (5, 0.1), (4, 0.5), (3, 0.9)):
        got = portfolio_returns(df, "s", "o", horizon, top, F.col("p")).orderBy("place").collect()
        want = looped(rows, horizon, top)
        assert [(r.date, r.phase, r.n, r.k) for r in got] == [w[:4] for w in want] and [r.place for r in got] == list(range(len(want)))
        assert all(abs(r.long - w[4]) < 1e-12 and abs(r.short - w[5]) < 1e-12 and abs(r.spread - w[4] + w[5]) < 1e-12 for r, w in zip(got, want, strict=True))
    assert portfolio_returns(df.where("false"), "s", "o").count() == 0
