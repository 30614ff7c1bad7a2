"""Units of volume against a walk over an entity's years."""

import datetime
from statistics import median

from stratagrid.operators import units as u


def walked(rows):
    """(year, ratio) of one entity: unit by year, or None."""
    by = {}
    for y, r in rows:
        by.setdefault(y, []).append(r)
    level = lambda m, other: 1 if m < 40 else 100 if m > 60 else other
    known, newer = {}, None
    for y in sorted((y for y in by if len(by[y]) >= 5), reverse=True):
        m = median(by[y])
        known[y] = level(m, 1) if newer is None else 1 if newer[0] / m >= 15 else 100 if newer[0] / m <= 1 / 15 else newer[1]
        newer = (m, known[y])
    if not known:
        return dict.fromkeys(by, level(median(r for _, r in rows), None))
    return {y: known[min(known, key=lambda k: (abs(k - y), k))] for y in by}


CASES = {
    1: {2010: [100] * 6, 2011: [90] * 6, 2012: [1.0] * 9},  # a flip
    2: {2010: [1.1] * 6, 2011: [95] * 6, 2012: [1.0] * 9},  # there and back
    3: {2010: [100] * 6, 2011: [100] * 2, 2013: [1.0] * 2, 2014: [1.0] * 9},  # years of few rows: the nearest, of equals the earlier
    4: {2010: [50.0] * 9},  # the newest year says nothing
    5: {2010: [80.0] * 2, 2011: [90.0]},  # no year of enough rows
    6: {2010: [45.0] * 2, 2011: [50.0]},  # and none the wiser
    7: {2010: [1e5] * 6, 2011: [1.0] * 6},  # nothing explains 2010
    8: {2010: [1, 1, 1, 1, 1, 1, 100, 1e4, 1e-4], 2009: [100] * 8 + [1.0, 1e4, 100 / 25, 1e-2]},  # strays and junk
}


def frame(spark):
    rows = []
    for k, by in CASES.items():
        for y, ratios in by.items():
            rows += [(k, datetime.date(y, 1, 1 + i), 2.0, float(r) * 20.0, 10.0) for i, r in enumerate(ratios)]
    rows += [(1, datetime.date(2012, 6, d), *v) for d, v in enumerate([(None, 1.0, 1.0), (0.0, 1.0, 1.0), (1.0, -1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, float("inf")), (1.0, 1.0, None)], 1)]
    rows += [(9, datetime.date(2012, 6, 1), 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "entity int, date date, close double, amount double, volume double").repartition(3)


def test_years(spark):
    got = {}
    for r in u.years(u.with_ratio(frame(spark))).collect():
        got.setdefault(r.entity, {})[r.year] = r
    for k, by in CASES.items():
        assert {y: r.unit for y, r in got[k].items()} == walked([(y, v) for y, vs in by.items() for v in vs]), k
    assert got[7][2010].corrupt and not got[7][2011].corrupt and 9 not in got
    assert got[4][2010].unsure and got[6][2010].unsure and not got[5][2010].unsure


def test_rows(spark):
    rows = u.classified(frame(spark)).collect()
    assert len(rows) == frame(spark).count()
    of = lambda k, y: sorted((round(r.amount / r.volume / r.close, 9), r.flip, r.junk) for r in rows if r.entity == k and r.date.year == y and r.volume and r.close and r.unit is not None)
    assert of(8, 2010) == [(1e-4, False, True)] + [(1.0, False, False)] * 6 + [(100.0, True, False), (1e4, False, True)]
    assert of(8, 2009) == [(0.01, False, True), (1.0, False, False), (4.0, True, False)] + [(100.0, True, False)] * 8 + [(1e4, False, True)]
    assert all(j and not f for _, f, j in of(7, 2010)) and all(f for _, f, _ in of(1, 2010)) and not any(f or j for _, f, j in of(1, 2012))
    assert not any(r.flip or r.junk or r.unit for r in rows if r.entity in (6, 9))
    back = {(r.entity, r.date): r.volume for r in u.migrated(frame(spark)).collect()}
    assert back[1, datetime.date(2010, 1, 1)] == 1000.0 and back[1, datetime.date(2012, 1, 1)] == 10.0
    assert u.classified(frame(spark).where("false")).count() == 0
