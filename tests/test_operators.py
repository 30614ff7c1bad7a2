"""Edge rows that the driver's tables don't hold."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from stratagrid.operators import account, catalog, channels, contracts, series, technical, text
from stratagrid.sources import store

DAY = datetime.date(2024, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def bars(spark, closes, entity=1, scale=1.0):
    rows = [(entity, day(i), c * scale, c * scale * 1.02, c * scale * 0.97, c * scale, 100.0 + i, 1000.0 * scale) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "entity long, date date, open double, high double, low double, close double, volume double, amount double")


CLOSES = [10 + (i * 37 % 11) / 7 for i in range(80)]


def test_recursive_averages_equal_pandas(spark):
    got = technical.recursive(bars(spark, CLOSES)).orderBy("date").toPandas()
    c = pd.Series(CLOSES)
    assert (got.ema_12 - c.ewm(span=12, adjust=False).mean() / c).abs().max() < 1e-12
    assert got.rsi_6.isna().sum() == 1


def test_indicators_do_not_depend_on_the_price_level(spark):
    names = technical.kbar() | technical.moving_averages((5, 20)) | technical.bollinger() | {"atr": technical.atr()}
    one, ten = (technical.prepared(bars(spark, CLOSES, scale=s)).withColumns(names).orderBy("date").select(*names).toPandas() for s in (1.0, 10.0))
    assert ((one - ten).abs().max() < 1e-9).all()


def test_single_rows_and_nulls(spark):
    df = bars(spark, [5.0])
    assert technical.recursive(df).count() == 1
    assert technical.prepared(df).withColumns(technical.trend(5)).first().beta_5 is None
    assert technical.recursive(df.limit(0)).count() == 0


def test_open_interval_and_bounds(spark):
    rows = bars(spark, CLOSES).select("entity", "date")
    spans = spark.createDataFrame([(1, day(0), day(3)), (1, day(2), day(5)), (1, day(70), None)], "entity long, in_date date, out_date date")
    got = {r.date for r in channels.member_flag(rows, spans).where("is_member").collect()}
    assert got == {day(i) for i in [*range(5), *range(70, 80)]}


def test_event_channel_never_sees_its_own_day(spark):
    aux = spark.createDataFrame([(1, day(3), 7.0)], "entity long, date date, x double")
    got = [r.x for r in channels.event_channel(bars(spark, CLOSES[:6]), aux, ["x"]).orderBy("date").collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 7.0, 0.0]


def test_staleness_before_the_first_observation(spark):
    aux = spark.createDataFrame([(1, day(1), 7.0)], "entity long, date date, x double")
    rows = channels.state_channel(bars(spark, CLOSES[:10]), aux, ["x"], stale_after=5).orderBy("date").collect()
    assert [r.ever_seen for r in rows[:3]] == [False, False, True]
    assert rows[0].is_stale and not rows[3].is_stale and rows[8].is_stale


def test_gaps_are_filled_by_length(spark):
    x = [1.0, None, 3.0, 3.5, None, None, None, 5.0, *[None] * 12, 6.0]
    df = spark.createDataFrame([(1, day(i), v) for i, v in enumerate(x)], "entity long, date date, x double")
    got = [r.filled for r in series.imputed(df, "x").orderBy("date").collect()]
    assert got[1] == 1.0 and got[4] is not None and got[4] != 3.5 and all(v is None for v in got[8:20])


def test_account_keeps_its_identity(spark):
    both = bars(spark, CLOSES).unionByName(bars(spark, CLOSES[::-1], 2))
    buys = account.orders(both.withColumn("score", F.col("close")), "score", 0.5, 5)
    days, book = account.daily(buys, 5).orderBy("date").toPandas(), account.ledger(buys, 5).toPandas()
    assert (days.cash > -1e-9).all() and (days.exposure <= 1 + 1e-9).all()
    assert abs(days.nav.iloc[-1] - 1 - book[book.outcome != "unresolved"].pnl.sum() + book[book.outcome == "unresolved"].cost.sum()) < 1e-6


def test_account_is_the_fold_over_positions(spark):
    """Days and positions one by one, as a person would keep the book."""
    import random

    rng, rows = random.Random(4), []
    for day in range(40):
        for name in range(rng.randrange(5)):
            sold = None if rng.random() < 0.1 else day + 3 + rng.randrange(3)
            rows.append((name, day, sold, rng.uniform(5, 20), rng.uniform(5, 20), "sold" if sold else "unresolved"))
    start = datetime.date(2020, 1, 1)
    at = lambda d: None if d is None else start + datetime.timedelta(days=d)
    df = spark.createDataFrame([(e, at(b), at(s), x, y, o) for e, b, s, x, y, o in rows], "entity int, bought date, sold date, entry double, leave double, outcome string").repartition(5)
    cash, held, days, book = 1.0, [], {}, {}
    for day in range(50):
        gone = [p for p in held if p["sold"] == day]
        for p in gone:
            gain = p["shares"] * p["leave"]
            cash += gain * (1 - 0.001)
            book[p["name"], p["day"]] = (p["shares"], p["cost"] + gain * 0.001, gain - p["shares"] * p["entry"] - p["cost"] - gain * 0.001)
        held = [p for p in held if p["sold"] != day]
        buys = [r for r in rows if r[1] == day]
        if buys:
            each = min((cash + sum(p["shares"] * p["entry"] for p in held)) / 4, cash) / len(buys)
            for name, _, sold, entry, leave, _ in buys:
                shares = each / (entry * 1.001)
                cash -= shares * entry * 1.001
                held.append({"name": name, "day": day, "sold": sold, "shares": shares, "entry": entry, "leave": leave, "cost": shares * entry * 0.001})
        if gone or buys:
            days[at(day)] = (cash + sum(p["shares"] * p["entry"] for p in held), cash, len(held))
    book |= {(p["name"], p["day"]): (p["shares"], p["cost"], p["shares"] * (p["leave"] - p["entry"]) - p["cost"]) for p in held}
    got = {r.date: (r.nav, r.cash, r.positions) for r in account.daily(df, 4, 0.001).collect()}
    assert got.keys() == days.keys() and all(max(abs(a - b) for a, b in zip(got[d], days[d], strict=True)) < 1e-9 for d in days)
    kept = {(r.entity, (r.bought - start).days): (r.shares, r.cost, r.pnl) for r in account.ledger(df, 4, 0.001).collect()}
    assert kept.keys() == book.keys() and all(max(abs(a - b) for a, b in zip(kept[k], book[k], strict=True)) < 1e-9 for k in book)


def test_bootstrap_is_the_same_on_any_partitions(spark):
    df = spark.range(300).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.sin("id").alias("r"))
    one, other = (sorted((r.round, round(r.m, 12)) for r in account.resampled(df.repartition(n), "r", 200, 7).collect()) for n in (1, 9))
    assert one == other and len({m for _, m in one}) > 150
    got = account.bootstrap_mean(df, "r", 200, 7).first()
    assert got.rounds == 200 and got.low < got.mean < got.high and abs(got.mean - df.agg(F.avg("r")).first()[0]) < 0.02
    assert account.bootstrap_mean(df.where("false"), "r").first().rounds == 0


def test_codes(spark):
    raw = ["SH600001", "600001.SH", "1.0", "SZ600001", "abc", None, "000001.SZ", "1234567"]
    got = [r.code for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(contracts.normal_code("raw").alias("code")).collect()]
    assert got == ["600001", "600001", "000001", None, None, None, "000001", None]


def test_contract_counts(spark):
    bad = bars(spark, CLOSES[:3]).withColumn("pct_change", F.lit(0.0)).withColumn("high", F.lit(1.0))
    got = {r.rule: r.violations for r in contracts.report(bad, contracts.bar_rules()).collect()}
    assert got["above_high"] == 3 and got["below_low"] == 0 and got["price_not_positive"] == 0


def test_versions(spark, tmp_path):
    df = bars(spark, CLOSES[:4])
    root = str(tmp_path / "v")
    assert store.current_version(spark, root) is None
    store.upsert(df, root, ["entity", "date"])
    store.upsert(df.limit(1).withColumn("close", F.lit(-1.0)), root, ["entity", "date"])
    assert store.current_version(spark, root) == 2
    assert store.read_version(spark, root).where("close = -1").count() == 1 and store.read_version(spark, root, 1).where("close = -1").count() == 0


def test_alignment_after_the_close(spark):
    posts = spark.createDataFrame([(1, datetime.datetime(2024, 1, 5, 14, 59)), (2, datetime.datetime(2024, 1, 5, 15, 1)), (3, datetime.datetime(2024, 1, 6, 16, 0))], "k int, ts timestamp")
    cal = spark.createDataFrame([(datetime.date(2024, 1, d),) for d in (4, 5, 8, 9)], "date date")
    assert {r.k: r.aligned_date.day for r in text.aligned(posts, cal).collect()} == {1: 5, 2: 8, 3: 8}


def test_letters_of_any_script_are_no_noise(spark):
    texts = ["Привет мир", "καλημέρα", "你好世界再见", "١٢٣٤٥٦", "...\n***", "_____", "—–…¡¿", "abc", "?!?!?a", None]
    got = [r.noise for r in spark.createDataFrame(list(enumerate(texts)), "k int, text string").orderBy("k").select(text.is_noise("text").alias("noise")).collect()]
    assert got == [False, False, False, False, True, True, True, True, False, None]


def test_catalog_keeps_the_last_row_fills_lags_and_ages(spark):
    b = bars(spark, [1.0, 2.0, 3.0, 4.0]).select("entity", "date", "close")
    key = "entity long, date date, "
    flow = spark.createDataFrame([(1, day(1), 5.0, 1, 9.0), (1, day(1), 7.0, 2, 9.0)], key + "net double, at int, close double")
    held = spark.createDataFrame([(1, day(0), 3.0), (1, day(2), None)], key + "pledge_ratio double")
    got = catalog.merged(b, {"pledge": held, "capital_flow": flow, "comment": None}, order="at").orderBy("date").collect()
    assert [r.net for r in got] == [0.0, 0.0, 7.0, 0.0] and [r.close for r in got] == [1.0, 2.0, 3.0, 4.0]
    assert [r.pledge_ratio for r in got] == [0.0, 3.0, 3.0, 3.0]
    assert [r.pledge_staleness_days for r in got] == [0, 0, 1, 2] and [r.pledge_has_ever_observed for r in got] == [False, True, True, True]


def test_catalog_of_empty_sources_and_scrubbed_names(spark):
    b = bars(spark, [1.0, 2.0]).select("entity", "date", "close")
    none = spark.createDataFrame([], "entity long, date date, margin_balance double")
    got = catalog.merged(b, {"margin": none, "limit_up": none}).collect()
    assert [(r.margin_balance, r.margin_is_stale, r.margin_has_ever_observed) for r in got] == [(0.0, False, False)] * 2
    assert catalog.scrubbed(["a", "a_lag5", "topic_1", "roe", "margin_net", "margin_is_stale"], off=("margin",)) == ["a", "roe"]


def test_only_the_indicators_asked_for(spark):
    """Each is the same alone as among all."""
    rows = [(i % 2, datetime.date(2024, 1, 1) + datetime.timedelta(i), 10.0 + (7 * i) % 5, 8.0 + (3 * i) % 4 - i / 50, 9.0 + (5 * i) % 7 / 3) for i in range(80)]
    df = spark.createDataFrame(rows, "entity int, date date, high double, low double, close double")
    every = technical.recursive(df).orderBy("entity", "date").toPandas()
    for some in (("trix", "ema_12"), ("rsi_24", "adxr", "kdj_j_14"), ("macd_hist",)):
        got = technical.recursive(df, some)
        assert got.columns == ["entity", "date", *some]
        assert got.orderBy("entity", "date").toPandas().equals(every[["entity", "date", *some]])
