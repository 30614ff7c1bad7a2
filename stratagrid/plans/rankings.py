"""Queries of group rankings, coverage, moments and keep-one rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.windows import before
from stratagrid.operators import rankings as k
from stratagrid.operators.technical import prepared
from stratagrid.plans.aggregates import BRANDED, branded
from stratagrid.plans.bars import daily
from stratagrid.plans.cross_section import HEAD, panel
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS, PREPARED, E
from stratagrid.session import table


@query("ag05_industry_ranking", HEAD + """, g AS (SELECT date, sector, round(avg(ret), 6) AS change, round(stddev_samp(ret), 6) AS dev, count(*) AS names, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS down FROM m WHERE ret IS NOT NULL GROUP BY 1, 2),
l AS (SELECT date, sector, entity AS leader FROM m WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY ret DESC, entity) = 1)
SELECT g.*, leader, rank() OVER (PARTITION BY date ORDER BY change DESC) AS place FROM g JOIN l USING (date, sector)""")  # fmt: skip
def industry_ranking(spark, sf_dir):
    return k.industry_ranking(panel(spark, sf_dir))


@query("cx19_hot_groups", BRANDED + """, d AS (SELECT date, board, round(sum(premium), 6) AS value FROM b GROUP BY 1, 2),
r AS (SELECT date, board, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS share FROM d)
SELECT date, board, round(share, 6) AS share FROM r WHERE share > 0.9""")
def hot_groups(spark, sf_dir):
    d = branded(spark, sf_dir).groupBy("date", "board").agg(F.round(F.sum("premium"), 6).alias("value"))
    return k.hot(d, "board", "value").withColumn("share", F.round("share", 6))


@query("md06_coverage_by_year", f"WITH bars AS ({BARS}), c AS (SELECT DISTINCT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, 1 AS c FROM lineitem WHERE l_returnflag = 'R') SELECT year(date)::INT AS year, count(*) AS traded, count(c) AS covered, round(count(c) / count(*), 6) AS share FROM bars LEFT JOIN c USING (entity, date) GROUP BY 1")
def coverage_by_year(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    covered = li.select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date"))
    return k.coverage_by_year(daily(spark, sf_dir), covered).withColumn("share", F.round("share", 6))


@query("ud03_unbiased_moments", PREPARED + " SELECT entity, count(ret) AS n, round(skewness(ret), 5) AS skew, round(kurtosis(ret), 5) AS kurt FROM p GROUP BY 1")
def unbiased_moments(spark, sf_dir):
    found = k.unbiased_moments(prepared(daily(spark, sf_dir)), "entity", "ret")
    return found.withColumns({"skew": F.round("skew", 5), "kurt": F.round("kurt", 5)})


@query("jn13_listed", f"WITH bars AS ({BARS}), s AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1999-01-01' + CAST(s_suppkey % 700 AS INT) END AS delisted FROM supplier) SELECT entity, date, CASE WHEN date >= delisted THEN 0 ELSE 1 END AS is_listed FROM bars LEFT JOIN s USING (entity)")
def listed(spark, sf_dir):
    key = F.col("s_suppkey")
    status = table(spark, sf_dir, "supplier").select(key.alias("entity"), F.when(key % 3 == 0, F.date_add(F.lit("1999-01-01").cast("date"), (key % 700).cast("int"))).alias("delisted"))
    return k.listed(daily(spark, sf_dir).select("entity", "date"), status)


@query("wo08_count_before", f"WITH bars AS ({BARS}) SELECT entity, date, count(*) FILTER (volume > 30) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS listed_5d FROM bars")
def count_before(spark, sf_dir):
    return k.count_before(daily(spark, sf_dir), F.col("volume") > 30, 5, "listed_5d").select("entity", "date", "listed_5d")


@query("tk05_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM orders GROUP BY 1")
def keep_last(spark, sf_dir):
    return k.keep_one(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("tk05_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, round(arg_min(o_totalprice, o_orderkey), 2) AS o_totalprice FROM orders GROUP BY 1")
def keep_first(spark, sf_dir):
    return k.keep_one(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", False).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("pf12_change_identity", f"WITH bars AS ({BARS}), b AS (SELECT entity, date, volume, (close / lag(close) OVER {E} - 1) * 100 AS own FROM bars) SELECT entity, count(*) FILTER (own IS NOT NULL AND abs(round(volume, 2) - own) > 0.5) AS off FROM b GROUP BY 1")
def change_identity(spark, sf_dir):
    own = (F.try_divide(F.col("close"), before("close")) - 1) * 100
    rows = daily(spark, sf_dir).withColumn("own", own)
    return rows.groupBy("entity").agg(F.count_if(F.col("own").isNotNull() & (F.abs(F.round("volume", 2) - F.col("own")) > 0.5)).alias("off"))
