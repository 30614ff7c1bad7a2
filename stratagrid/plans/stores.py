"""Queries of stores, accounts and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratagrid.operators import account, series
from stratagrid.operators import evaluation as ev
from stratagrid.plans.aggregates import BOOK, book
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.series import DENSE
from stratagrid.plans.sql import BARS, PREPARED, E
from stratagrid.session import shared_dir, table
from stratagrid.sources import store


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query("sc01_scan_range", f"WITH bars AS ({BARS}) SELECT entity, date, close FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND entity IN (1, 2, 3)")
def scan_range(spark, sf_dir):
    path = scratch(spark)
    daily(spark, sf_dir).write.parquet(path)
    return store.scan(spark, path, None, "1997-01-01", "1997-12-31", [1, 2, 3], ["entity", "date", "close"])


@query("sc03_entities", "SELECT DISTINCT l_suppkey AS entity FROM lineitem")
def entities(spark, sf_dir):
    return store.entities(daily(spark, sf_dir))


@query("sc08_10_partitioned", f"WITH bars AS ({BARS}) SELECT year(date)::INT AS year, month(date)::INT AS month, count(*) AS n, sum(volume) AS volume FROM bars WHERE year(date) = 1998 GROUP BY 1, 2")
def partitioned(spark, sf_dir):
    path = scratch(spark)
    store.partitioned(store.with_year_month(daily(spark, sf_dir)), path, "year", "month")
    return spark.read.parquet(path).where("year = 1998").groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("sc02_19_versions", f"WITH bars AS ({BARS}) SELECT entity, date, CASE WHEN date >= DATE '2001-01-01' THEN -volume ELSE volume END AS volume FROM bars")
def versions(spark, sf_dir):
    root, d = scratch(spark), daily(spark, sf_dir).select("entity", "date", "volume")
    store.upsert(d, root, ["entity", "date"])
    store.upsert(d.where("date >= date '2001-01-01'").withColumn("volume", -F.col("volume")), root, ["entity", "date"])
    return store.read_version(spark, root)


@query("sc05_21_manifest", f"WITH bars AS ({BARS}) SELECT count(*) AS rows, count(DISTINCT (entity, date)) AS keys, min(date) AS first, max(date) AS last, true AS same FROM bars")
def manifest(spark, sf_dir):
    d = daily(spark, sf_dir).select("entity", "date", "volume")
    a, b = store.manifest(d, ["entity", "date"]), store.manifest(d.orderBy("volume"), ["entity", "date"])
    both = a.join(b.select(F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("schema").alias("s2")), (F.col("low") == F.col("l2")) & (F.col("schema") == F.col("s2")))
    return both.select("rows", "keys", "first", "last", (F.col("high") == F.col("h2")).alias("same"))


@query("sc09_point_date", f"WITH bars AS ({BARS}) SELECT entity, volume FROM bars WHERE date = (SELECT max(date) FROM bars)")
def point_date(spark, sf_dir):
    d = daily(spark, sf_dir)
    last = d.agg(F.max("date").alias("m"))
    return d.where(F.col("date") == last.scalar()).select("entity", "volume")


@query("sc12_first_posts", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY 2")
def first_posts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("sc26_panel_scan", f"WITH bars AS ({BARS}), k AS (SELECT entity, date, volume, count(*) OVER (PARTITION BY entity) AS n FROM bars WHERE date >= DATE '1996-01-01') SELECT entity, date, volume, s_nationkey AS sector FROM k LEFT JOIN supplier ON s_suppkey = entity WHERE n >= 400")
def panel_scan(spark, sf_dir):
    from pyspark.sql.window import Window

    from stratagrid.operators.cross_section import with_sector

    d = daily(spark, sf_dir).where("date >= date '1996-01-01'").select("entity", "date", "volume").withColumn("n", F.count("*").over(Window.partitionBy("entity"))).where("n >= 400").drop("n")
    return with_sector(d, table(spark, sf_dir, "supplier"))


@query("sc27_calendar", "SELECT date, row_number() OVER (ORDER BY date) AS session_no FROM (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS date) WHERE isodow(date) < 6 AND date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)")
def calendar(spark, sf_dir):
    off = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return store.calendar(spark, "2000-01-01", "2000-12-31", off).withColumn("session_no", F.col("session_no").cast("long"))


@query("sc28_universe", "WITH a AS (SELECT s_suppkey AS entity, DATE '1995-01-01' + CAST(s_suppkey AS INT) AS list_date FROM supplier WHERE s_suppkey % 4 <> 0), b AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1999-01-01' END AS suspended, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1999-06-01' END AS effective FROM supplier WHERE s_suppkey % 5 = 0) SELECT coalesce(a.entity, b.entity) AS entity, list_date, coalesce(suspended, effective) AS exit_date, CASE WHEN effective IS NOT NULL THEN 'delisted' WHEN suspended IS NOT NULL THEN 'suspended' ELSE 'listed' END AS status FROM a FULL JOIN b ON a.entity = b.entity")
def universe(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"))
    e = F.col("entity")
    a = s.where(e % 4 != 0).withColumn("list_date", F.date_add(F.lit("1995-01-01").cast("date"), e.cast("int")))
    b = s.where(e % 5 == 0).withColumns({"suspended": F.when(e % 2 == 0, F.lit("1999-01-01").cast("date")), "effective": F.when(e % 3 == 0, F.lit("1999-06-01").cast("date"))})
    return store.universe(a, b)


@query("sc30_wide_long_wide", "SELECT c_custkey, c_acctbal AS y0, round(c_acctbal * 2, 2) AS y1 FROM customer")
def wide_long_wide(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("y0"), F.round(F.col("c_acctbal") * 2, 2).alias("y1"))
    return store.long_to_wide(store.wide_to_long(wide, ["c_custkey"]), ["c_custkey"], "period", ["y0", "y1"], "value")


@query("md12_compaction", f"WITH bars AS ({BARS}) SELECT entity, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY 1")
def compaction(spark, sf_dir):
    path = scratch(spark)
    store.compact(daily(spark, sf_dir), path, 4)
    return spark.read.parquet(path).groupBy("entity").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("sc25_reports", f"WITH bars AS ({BARS}) SELECT year(date)::INT AS year, count(*)::INT AS n FROM bars GROUP BY 1")
def reports(spark, sf_dir):
    path = scratch(spark)
    store.report(daily(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("year int, n int").option("header", True).csv(path)


def bought(spark, sf_dir):
    # prices of the table are random from day to day: held nearer to 1000, so that the account stays within a few digits
    dense = series.grid(daily(spark, sf_dir)).withColumns({c: 1000 + (F.col(c) - 1000) / 50 for c in ("open", "close")})
    from stratagrid.functions.windows import before

    scored = dense.withColumn("score", F.try_divide(before("close"), before("close", 2)) - 1)
    return account.orders(scored, "score", 0.1, 5)


AFTER = "(PARTITION BY entity ORDER BY date ROWS BETWEEN 6 FOLLOWING AND UNBOUNDED FOLLOWING)"
#: Orders, their days numbered, and the account a day at a time with all budgets so far.
ACCOUNT = PREPARED.replace("WITH bars", "WITH RECURSIVE bars", 1) + DENSE + f""", dp AS (SELECT entity, date, 1000 + (open - 1000) / 50 AS open, 1000 + (close - 1000) / 50 AS close FROM d), sc AS (SELECT *, lag(close) OVER {E} / lag(close, 2) OVER {E} - 1 AS score FROM dp),
od AS (SELECT *, count(score) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, entity) AS place, lead(date) OVER {E} AS bought, lead(open) OVER {E} AS entry, lead(date, 6) OVER {E} AS due,
  first_value(CASE WHEN open IS NOT NULL THEN date END IGNORE NULLS) OVER {AFTER} AS sold, first_value(open IGNORE NULLS) OVER {AFTER} AS leave, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM sc),
bo AS MATERIALIZED (SELECT entity, bought, entry, sold, coalesce(leave, final) AS leave, CASE WHEN sold IS NULL THEN 'unresolved' WHEN sold > due THEN 'delayed' ELSE 'sold' END AS outcome, count(*) OVER (PARTITION BY bought) AS names
  FROM od WHERE score IS NOT NULL AND place <= greatest(1, least(n, round_even(n * 0.1::DOUBLE, 0))) AND entry IS NOT NULL),
dy AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT bought AS date FROM bo UNION SELECT sold FROM bo WHERE sold IS NOT NULL)),
fl AS MATERIALIZED (SELECT x.i AS b, y.i AS s, count(*) / max(names) AS part, sum(leave / entry) / max(names) AS gain, count(*) AS n FROM bo JOIN dy x ON x.date = bought LEFT JOIN dy y ON y.date = sold GROUP BY 1, 2),
ac AS (SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS held, CAST([] AS DOUBLE[]) AS budgets, CAST(0 AS BIGINT) AS positions
  UNION ALL SELECT i, cash - budget, held + budget / 1.0005::DOUBLE, list_append(budgets, budget), positions + news FROM
   (SELECT *, CASE WHEN news > 0 THEN least((cash + held) / 5, cash) ELSE 0 END AS budget FROM
    (SELECT ac.i + 1 AS i, cash + coalesce((SELECT sum(ac.budgets[fl.b] * gain) FROM fl WHERE fl.s = ac.i + 1), 0) / 1.0005::DOUBLE * 0.9995::DOUBLE AS cash,
       held - coalesce((SELECT sum(ac.budgets[fl.b] * part) FROM fl WHERE fl.s = ac.i + 1), 0) / 1.0005::DOUBLE AS held, budgets,
       positions - coalesce((SELECT sum(n) FROM fl WHERE fl.s = ac.i + 1), 0)::BIGINT AS positions, coalesce((SELECT sum(n) FROM fl WHERE fl.b = ac.i + 1), 0)::BIGINT AS news
     FROM ac WHERE ac.i < (SELECT max(i) FROM dy)))),
fi AS MATERIALIZED (SELECT i, cash, held, positions, budgets[-1] AS budget FROM ac WHERE i > 0)"""


@query("ud09_account_daily", ACCOUNT + " SELECT date, round(cash + held, 7) AS nav, round(cash, 7) AS cash, positions, round(CASE WHEN positions > 0 THEN held / (cash + held) ELSE 0 END, 7) AS exposure FROM fi JOIN dy USING (i)")
def account_daily(spark, sf_dir):
    out = account.daily(bought(spark, sf_dir), 5)
    return out.select("date", F.round("nav", 7).alias("nav"), F.round("cash", 7).alias("cash"), F.col("positions").cast("long").alias("positions"), F.round("exposure", 7).alias("exposure"))


@query("ud09_account_ledger", ACCOUNT + """, le AS (SELECT bo.*, budget / (names * 1.0005::DOUBLE) AS v FROM bo JOIN dy ON dy.date = bought JOIN fi USING (i)),
lp AS (SELECT *, v / entry * leave AS gain, v * 0.0005::DOUBLE + CASE WHEN sold IS NOT NULL THEN v / entry * leave * 0.0005::DOUBLE ELSE 0 END AS paid FROM le)
SELECT entity, bought, sold, round(v / entry, 9) AS shares, round(entry, 10) AS entry, round(leave, 10) AS leave, round(paid, 9) AS cost, round(gain - v - paid, 9) AS pnl, outcome FROM lp""")
def account_ledger(spark, sf_dir):
    out = account.ledger(bought(spark, sf_dir), 5)
    return out.select("entity", "bought", "sold", F.round("shares", 9).alias("shares"), F.round("entry", 10).alias("entry"), F.round("leave", 10).alias("leave"), F.round("cost", 9).alias("cost"), F.round("pnl", 9).alias("pnl"), "outcome")


@query("ud07_bootstrap", BOOK + f""", dn AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, r FROM r WHERE r IS NOT NULL), cn AS (SELECT count(*) AS n FROM dn),
pk AS (SELECT a.round, b.j, n FROM cn, (SELECT unnest(range(500)) AS round) a, LATERAL (SELECT unnest(range(CAST(ceil(n / 5.0) AS BIGINT))) AS j) b),
st AS (SELECT round, j, n, CAST(floor(((('0x' || substr(md5(concat_ws('|', '42', round::VARCHAR, j::VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / {16**13}.0::DOUBLE) * greatest(1, n - 4)) AS BIGINT) AS s FROM pk),
ix AS (SELECT round, unnest(range(s, s + least(5, n - j * 5))) AS i FROM st), ms AS (SELECT round, avg(r) AS m FROM ix JOIN dn USING (i) GROUP BY 1)
SELECT count(*) AS rounds, round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM ms""")
def bootstrap(spark, sf_dir):
    out = account.bootstrap_mean(book(spark, sf_dir), "r", 500, 5)
    return out.select("rounds", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query("ud08_probabilistic_sharpe", BOOK + ", s AS (SELECT count(r) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS g3, kurtosis_pop(r) AS g4 FROM r) SELECT n, round(sr, 6) AS sr FROM s")
def probabilistic_sharpe(spark, sf_dir):
    return ev.probabilistic_sharpe(book(spark, sf_dir)).select("n", F.round("sr", 6).alias("sr"))


@query("ud10_blended", BOOK + ", c AS (SELECT date, exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e FROM r) SELECT date, round(0.6 * e + 0.4 * e, 6) AS equity FROM c")
def blended(spark, sf_dir):
    e = ev.equity(book(spark, sf_dir))
    return account.blended(e, e.select("date", "equity"), 0.6, 0.4).select("date", F.round("equity", 6).alias("equity"))


@query("ud20_by_date", f"WITH bars AS ({BARS}) SELECT date, count(*) AS n, list_sort(list(entity)) AS entities FROM bars GROUP BY 1")
def by_date(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("entity")).alias("entities"))
