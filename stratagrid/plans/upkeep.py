"""Queries of upkeep and of the text chains' halves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratagrid.operators import channels, series
from stratagrid.operators import upkeep as u
from stratagrid.plans import chains
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS, E, w
from stratagrid.plans.text import KEPT, POSTS, posts
from stratagrid.session import shared_dir, table

CLASSES = "SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, CAST(CASE WHEN max(l_linenumber) < 5 THEN max(l_linenumber) END AS INT) AS class FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"


@query("md05_tail_merge", f"""WITH e AS ({CLASSES}), k AS (SELECT *, lag(class) OVER {E} AS former FROM e WHERE date < DATE '1996-01-01' AND class IS NOT NULL),
h AS (SELECT entity, class, date AS in_date, lead(date) OVER {E} AS out_date FROM k WHERE former IS NULL OR former <> class),
t AS (SELECT e.* FROM e LEFT JOIN (SELECT entity, max(in_date) AS last FROM h GROUP BY 1) USING (entity) WHERE date >= DATE '1995-12-01' AND (last IS NULL OR date > last)),
f AS (SELECT entity, min(date) AS first FROM t GROUP BY 1), n AS (SELECT entity, class, date AS in_date, lead(date) OVER {E} AS out_date FROM t)
SELECT entity, class, in_date, coalesce(out_date, first) AS out_date FROM h LEFT JOIN f USING (entity) UNION ALL SELECT * FROM n WHERE class IS NOT NULL""")
def tail_merge(spark, sf_dir):
    e = spark.sql(CLASSES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    held = channels.changes_to_intervals(e.where("date < date '1996-01-01' and class is not null"), "class")
    return u.extended(held, e.where("date >= date '1995-12-01'"), "class")


LIFTED = ", ".join(f"CASE WHEN min({c}) OVER (PARTITION BY entity) < 0 THEN greatest({c}, 0.01) ELSE {c} END AS {c}" for c in ("low", "close"))


@query("md14_bad_prices", f"WITH bars AS ({BARS}), s AS (SELECT entity, date, low - 910 AS low, close - 950 AS close FROM bars) SELECT entity, date, {LIFTED} FROM s")
def bad_prices(spark, sf_dir):
    shifted = daily(spark, sf_dir).select("entity", "date", (F.col("low") - 910).alias("low"), (F.col("close") - 950).alias("close"))
    return u.lifted(shifted, ["low", "close"])


@query("md08_out_of_band", f"""WITH bars AS ({BARS}), i AS (SELECT entity, close, amount / (volume * 0.9 * CASE WHEN date < DATE '1995-06-01' THEN 100 ELSE 1 END) AS p FROM bars)
SELECT entity, count(*) FILTER (p < close / 100 OR p > close * 100) AS outside, count(*) AS checked FROM i GROUP BY 1""")
def out_of_band(spark, sf_dir):
    return u.out_of_band(daily(spark, sf_dir).withColumn("volume", F.col("volume") * 0.9), F.col("date") < F.lit("1995-06-01").cast("date"))


@query("cx03_mergeable_dates", f"""WITH bars AS ({BARS}), v AS (SELECT date, 'volume' AS feature, CAST(volume AS DOUBLE) AS v FROM bars UNION ALL SELECT date, 'width', floor(high - low) FROM bars)
SELECT date, feature, count(*) AS n, avg(v) AS mean, round(greatest(coalesce(stddev_samp(v), 1), 1e-8), 5) AS std FROM v GROUP BY 1, 2""")
def mergeable_dates(spark, sf_dir):
    """Chunks of entities are summed and stored one by one, then added up and finalised."""
    rows = daily(spark, sf_dir).select("entity", "date", F.col("volume").cast("double").alias("volume"), F.floor(F.col("high") - F.col("low")).cast("double").alias("width"))
    path = f"{shared_dir(spark)}/dates-{uuid.uuid4().hex}"
    for chunk in range(3):
        u.date_sums(rows.where(F.col("entity") % 3 == chunk), ["volume", "width"]).write.mode("append").parquet(path)
    out = u.date_statistics(u.added_up([spark.read.parquet(path)]))
    return out.select("date", "feature", "n", "mean", F.round("std", 5).alias("std"))


DECLARED = """SELECT CASE WHEN p_partkey % 50 = 0 THEN 'market_env' ELSE p_brand END AS channel, p_partkey AS part, CASE p_size % 4 WHEN 0 THEN 'immutable_snapshot' WHEN 1 THEN 'latest_revised' WHEN 2 THEN 'immutable_snapshot' END AS source_vintage,
CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE 'none' END AS transform, CASE WHEN p_partkey % 3 = 0 THEN 'verified' ELSE 'proxy' END AS pit_alignment FROM part"""


@query("pf32_vintage_gates", f"""WITH d AS ({DECLARED}), k AS (SELECT *, coalesce(source_vintage IN ('immutable_snapshot', 'latest_revised') AND transform = 'none', false) AS known, coalesce(source_vintage = 'immutable_snapshot', false) AS fixed FROM d)
SELECT part, channel, known AND fixed AND (pit_alignment = 'verified' OR channel = 'market_env') AS headline_strict, known AND fixed AS revision_safe, known AS allow_revised FROM k""")
def vintage_gates(spark, sf_dir):
    d = spark.sql(DECLARED.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return d.select("part", "channel", *(u.admitted(p, ["none"]).alias(p) for p in u.POLICIES))


MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS investors, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS accounts FROM orders GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)"
LAST20 = "(ORDER BY date ROWS 19 PRECEDING)"
MONTH_Z = ", ".join(f"CASE WHEN count({c}) OVER {LAST20} = 20 THEN coalesce(({c} - avg({c}) OVER {LAST20}) / nullif(stddev_samp({c}) OVER {LAST20}, 0), 0) ELSE 0 END AS {c}_z" for c in ("investors", "accounts"))


@query("ag07_account_part", f"""WITH m AS ({MONTHLY}), z AS (SELECT *, {MONTH_Z}, lead(date) OVER (ORDER BY date) AS next FROM m)
SELECT CAST(unnest(generate_series(date::TIMESTAMP, coalesce(next - 1, date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date, investors, accounts, round(investors_z, 6) AS investors_z, round(accounts_z, 6) AS accounts_z FROM z""")
def account_part(spark, sf_dir):
    m = spark.sql(MONTHLY.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return u.account_part(m, ["investors", "accounts"]).select("date", "investors", "accounts", F.round("investors_z", 6).alias("investors_z"), F.round("accounts_z", 6).alias("accounts_z"))


SOUND = "length(text) >= 5 AND NOT regexp_full_match(text, '[^\\pL\\pN]*')"


@query("chain_text_pre", POSTS.replace("WITH", "WITH RECURSIVE", 1) + f""", sound AS (SELECT * FROM posts WHERE {SOUND}), {KEPT.format(posts="sound")}, s AS (SELECT * FROM sound WHERE doc_id NOT IN (SELECT k FROM fallen))
SELECT doc_id, CASE WHEN score > 0.2 THEN 1 WHEN score < -0.2 THEN -1 ELSE 0 END AS side, round(power(0.5, date_diff('day', date, (SELECT max(date) FROM s)) / 7.0), 6) AS weight FROM s""")
def chain_text_pre(spark, sf_dir):
    out = chains.text_pre().run(posts(spark, sf_dir).drop("score"))
    return out.select("doc_id", "side", F.round("weight", 6).alias("weight"))


DAYS = [f"round(CASE WHEN count(mean) OVER {w(d)} >= {max(1, d // 3)} THEN {f}(mean) OVER {w(d)} END, 6) AS {k}_{d}" for d in (3, 5, 10, 20) for k, f in (("mean", "avg"), ("std", "stddev_samp"))]


@query("chain_text_aggregate", POSTS + ", s AS (SELECT entity, date, count(score) AS n, avg(score) AS mean FROM posts GROUP BY 1, 2) SELECT entity, date, n, " + ", ".join(DAYS) + " FROM s")
def chain_text_aggregate(spark, sf_dir):
    out = chains.text_aggregate().run(posts(spark, sf_dir))
    return out.select("entity", "date", "n", *(F.round(c, 6).alias(c) for c in series.text_windows("mean")))
