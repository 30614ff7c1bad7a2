"""Queries over all entities of a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.ranks import sql_normal_quantile
from stratagrid.functions.rolling import rolled
from stratagrid.functions.windows import before, rounded
from stratagrid.operators import cross_section as c
from stratagrid.operators.technical import prepared
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import PREPARED, E, full, nz, select, w
from stratagrid.session import table, tasks_for

X = "(PARTITION BY date)"
XS = "(PARTITION BY date, sector)"
#: Prepared bars with sector, size and a score (the 6-row momentum before today) beside the next return.
HEAD = PREPARED + f""",
m AS (SELECT p.*, s_nationkey AS sector, ln(greatest(close * volume, 1)) AS size, entity % 3 <> 0 AS member,
        lag(close / o6 - 1) OVER {E} AS score, lead(ret) OVER {E} AS fwd
      FROM (SELECT *, lag(close, 6) OVER {E} AS o6 FROM p) p LEFT JOIN supplier ON s_suppkey = entity)
"""


def panel(spark, sf_dir):
    """Prepared bars with sector, size, membership, a score and the next return."""
    df = c.with_sector(prepared(daily(spark, sf_dir)), table(spark, sf_dir, "supplier"))
    momentum = F.try_divide(F.col("close"), before("close", 6)) - 1
    return df.withColumns({"size": c.size_proxy(), "member": F.col("entity") % 3 != 0, "mom": momentum}).withColumns({"score": before("mom"), "fwd": before("ret", -1)})


def rank_sql(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0)"


def middle_sql(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) - rank() OVER (PARTITION BY date ORDER BY {x} DESC))"


def put(name: str, build, sql: dict[str, str], head: str = "", source: str = "m", reads: tuple[str, ...] = ()):
    """With ``reads`` the query gets these columns only, in tasks of whole dates whose rows don't grow with the table: no more bars than line items."""

    @query(name, select(sql, source, head=HEAD + head))
    def run(spark, sf_dir):
        df = panel(spark, sf_dir)
        if reads:
            df = df.select(*reads).repartition(tasks_for(table(spark, sf_dir, "lineitem")), "date")
        return build(df).select(rounded(*sql))


def z_sql(value: str) -> str:
    return f""", b AS (SELECT date, count({value}) AS n, avg({value}) AS mean, stddev_samp({value}) AS dev, sum({value}) AS s1, sum({value} * {value}) AS s2 FROM m GROUP BY date),
b2 AS (SELECT *, sum(n) OVER u AS pn, sum(s1) OVER u AS ps, sum(s2) OVER u AS pq FROM b WINDOW u AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
z AS (SELECT m.entity, m.date, (ret - CASE WHEN n < 5 THEN ps / pn ELSE mean END) / greatest(CASE WHEN n < 5 THEN sqrt(greatest(pq / pn - (ps / pn) * (ps / pn), 0)) ELSE coalesce(dev, 1) END, 1e-8) AS z FROM m JOIN b2 USING (date))"""


put("cx01_date_wise_z", lambda df: c.date_wise_z(df, "ret"), {"z": "z"}, z_sql("ret"), "z")
put("cx02_member_z", lambda df: c.date_wise_z(df, "ret", "member"), {"z": "z"}, z_sql("CASE WHEN member THEN ret END"), "z")
put("cx04_sector_neutral", lambda df: df.withColumn("n", c.sector_neutral("ret")), {"n": f"CASE WHEN count(ret) OVER {XS} >= 2 THEN ret - median(ret) OVER {XS} ELSE ret END"})
put("cx06_rank_normal", lambda df: c.with_rank_normal(df, "ret", "g"), {"g": f"CASE WHEN n < 2 THEN 0 WHEN ret IS NOT NULL THEN {sql_normal_quantile('q')} END"}, f""",
k AS (SELECT *, count(ret) OVER {X} AS n, {rank_sql('ret')} AS r FROM m),
k2 AS (SELECT *, greatest(1.0::DOUBLE / (n + 1), least(1 - 1.0::DOUBLE / (n + 1), (r::DOUBLE - 0.5) / n)) AS q FROM k)""", "k2", reads=("entity", "date", "ret"))
put("cx07_plain_z", lambda df: df.withColumn("z", c.plain_z("close")), {"z": f"(close - avg(close) OVER {X}) / (CASE WHEN stddev_samp(close) OVER {X} = 0 THEN 1 ELSE stddev_samp(close) OVER {X} END)"})
put("cx08_adaptive_strength", lambda df: rolled(df, lambda: {"a": c.adaptive_strength("ret")}), {"a": f"ret * (1 + 0.5 * CASE WHEN (stddev_samp(ret) OVER {w(20)} - stddev_samp(ret) OVER {w(60)}) / nullif(stddev_samp(ret) OVER {w(60)}, 0) IS NULL THEN 0 ELSE greatest(-0.5, least(1, (stddev_samp(ret) OVER {w(20)} - stddev_samp(ret) OVER {w(60)}) / nullif(stddev_samp(ret) OVER {w(60)}, 0))) END)"})
put("cx10_sector_relative", lambda df: df.withColumn("r", c.relative_to_sector("close")).withColumn("high", c.above_quantile("close", 0.8).cast("int")), {"r": f"CASE WHEN abs(median(close) OVER {XS}) <= 1e-8 THEN 1 ELSE close / median(close) OVER {XS} END", "high": f"CAST(close > quantile_cont(close, 0.8) OVER {X} AS INT)"})
put("cx13_quantile_rank", lambda df: c.with_quantile_rank(df, "ret"), {"qr": f"CASE WHEN count(g) OVER {X} = 1 THEN CASE WHEN ret > 0 THEN 0.5 END WHEN g IS NOT NULL THEN {rank_sql('g')} / count(g) OVER {X} END"}, ", k AS (SELECT *, CASE WHEN ret > 0 THEN ret END AS g FROM m)", "k")
put("cx14_target_z", lambda df: df.withColumn("z", c.target_z("fwd")), {"z": f"CASE WHEN count(fwd) OVER {X} >= 5 THEN (fwd - avg(fwd) OVER {X}) / greatest(stddev_pop(fwd) OVER {X}, 1e-8) END"})


@query("cx05_size_neutral", HEAD + f""",
k AS (SELECT *, size - avg(size) OVER {X} AS s, volume - avg(volume) OVER {X} AS y, count(volume) OVER {X} AS n FROM m),
k2 AS (SELECT *, sum(s * s) OVER {X} AS a, sum(s * s * s) OVER {X} AS b, sum(s * s * s * s) OVER {X} - (sum(s * s) OVER {X}) * (sum(s * s) OVER {X}) / n AS e, sum(s * y) OVER {X} AS f, sum(s * s * y) OVER {X} AS g FROM k)
SELECT entity, date, round(y - ((f * e - g * b) / (a * e - b * b) * s + (a * g - b * f) / (a * e - b * b) * (s * s - a / n)), 4) AS residual FROM k2 WHERE n >= 10""")
def size_neutral(spark, sf_dir):
    df = panel(spark, sf_dir).withColumn("n", F.count("volume").over(c.per_date())).where("n >= 10").drop("n")
    return c.size_neutral(df, "volume", "size").select(rounded("residual", places=4))


@query("cx11_12_sector_strength", HEAD + """,
s AS (SELECT date, sector, avg(ret) AS mean_change, stddev_samp(ret) AS dev, count(ret) AS n, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS down, first(entity ORDER BY ret DESC NULLS LAST, entity) AS leader FROM m GROUP BY 1, 2)
SELECT date, sector, round(mean_change, 6) AS mean_change, round(dev, 6) AS dev, n, up, down, leader, round(mean_change - avg(mean_change) OVER (PARTITION BY date), 6) AS strength,
  round((up - down) / CAST(nullif(up + down, 0) AS DOUBLE), 6) AS breadth, rank() OVER (PARTITION BY date ORDER BY mean_change DESC NULLS LAST) AS rank,
  round(CASE WHEN count(*) OVER (PARTITION BY date) < 3 THEN 0 ELSE mean_change - avg(mean_change) OVER (PARTITION BY date) END, 6) AS alpha FROM s""")
def sector_strength(spark, sf_dir):
    out = c.sector_strength(panel(spark, sf_dir), "ret")
    return out.select("date", "sector", *(F.round(x, 6).alias(x) for x in ("mean_change", "dev", "strength", "breadth", "alpha")), "n", "up", "down", "leader", "rank")


IC = HEAD + f""",
pool AS (SELECT * FROM m WHERE score IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT date, {middle_sql('score')} AS a, {middle_sql('fwd')} AS b FROM pool),
ic AS (SELECT date, count(*) AS n, CAST(sum(a * b) AS DOUBLE) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS ic FROM k GROUP BY date HAVING count(*) >= 10)"""


@query("cx15_daily_rank_ic", IC + " SELECT date, n, round(ic, 6) AS ic FROM ic WHERE ic IS NOT NULL")
def daily_rank_ic(spark, sf_dir):
    return c.daily_rank_ic(panel(spark, sf_dir), "score", "fwd").withColumn("ic", F.round("ic", 6))


@query("cx16_ic_summary", IC + """,
o AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM ic WHERE ic IS NOT NULL),
t AS (SELECT count(*) AS n, avg(ic) AS mean, stddev_pop(ic) AS dev, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS positive FROM o),
l AS (SELECT greatest(0, CAST(floor(4 * power(n / 100.0, 2.0 / 9)) AS INT)) AS lags FROM t),
g AS (SELECT d.k, (SELECT sum((a.ic - t.mean) * (b.ic - t.mean)) / max(t.n) FROM o a JOIN o b ON b.i = a.i - d.k, t) AS gamma FROM (SELECT unnest(generate_series(0, (SELECT lags FROM l))) AS k) d)
SELECT n AS days, round(mean, 6) AS mean, round(dev, 6) AS dev, round(mean / nullif(dev, 0), 6) AS ir, round(positive, 6) AS positive,
  round(mean / sqrt((SELECT sum(CASE WHEN k = 0 THEN gamma ELSE 2 * (1 - k / (lags + 1.0)) * gamma END) FROM g, l) / n), 6) AS t_stat FROM t""")
def ic_summary(spark, sf_dir):
    from stratagrid.operators.evaluation import ic_summary as summary

    return summary(c.daily_rank_ic(panel(spark, sf_dir), "score", "fwd")).select("days", *(F.round(x, 6).alias(x) for x in ("mean", "dev", "ir", "positive", "t_stat")))


@query("cx18_quintiles", HEAD + """,
k AS (SELECT date, fwd, ntile(5) OVER (PARTITION BY date ORDER BY score, entity) AS bucket FROM m WHERE score IS NOT NULL AND fwd IS NOT NULL)
SELECT bucket, round(avg(m), 6) AS mean_outcome, count(*) AS days FROM (SELECT date, bucket, avg(fwd) AS m FROM k GROUP BY 1, 2) GROUP BY 1""")
def quintiles(spark, sf_dir):
    return c.quintiles(panel(spark, sf_dir), "score", "fwd").withColumn("mean_outcome", F.round("mean_outcome", 6))


@query("cx20_sign_agreement", HEAD + """,
k AS (SELECT entity, date, list_filter([ret, score, dc], lambda x: x IS NOT NULL) AS v FROM m)
SELECT entity, date, round(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END)) / len(v), 6) AS share_up,
  round(list_sum(list_transform(v, lambda x: CASE WHEN x < 0 THEN 1.0::DOUBLE ELSE 0 END)) / len(v), 6) AS share_down, round(list_sum(list_transform(v, lambda x: CAST(sign(x) AS DOUBLE))) / len(v), 6) AS mean_sign,
  round(list_stddev_pop(v) / (list_avg(list_transform(v, lambda x: abs(x))) + 1e-10), 6) AS dispersion FROM k WHERE len(v) > 0""")
def sign_agreement(spark, sf_dir):
    df = panel(spark, sf_dir).where("ret is not null or score is not null or dc is not null")
    return df.withColumns(c.sign_agreement(["ret", "score", "dc"])).select(rounded("share_up", "share_down", "mean_sign", "dispersion"))


@query("tk01_top_bottom_k", HEAD + """,
k AS (SELECT entity, date, greatest(1, least(floor(n / 2.0), round_even(n * 0.1, 0))) AS k, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS b, row_number() OVER (PARTITION BY date ORDER BY score, entity) AS w
  FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM m WHERE score IS NOT NULL))
SELECT entity, date, CASE WHEN b <= k THEN 'long' WHEN w <= k THEN 'short' END AS side FROM k WHERE b <= k OR w <= k""")
def top_bottom_k(spark, sf_dir):
    return c.top_k(panel(spark, sf_dir), "score", 0.1).where("side is not null").select("entity", "date", "side")


@query("flagship", HEAD + f""",
f AS (SELECT entity, date, {full('close', 5)} / {nz('close')} AS ma_5, volume / {nz(full('volume', 5), '1')} AS volume_ratio, close / lag(close, 6) OVER {E} - 1 AS roc FROM m),
z AS (SELECT *, (roc - avg(roc) OVER {X}) / greatest(coalesce(stddev_samp(roc) OVER {X}, 1), 1e-8) AS z FROM f WHERE roc IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY z DESC, entity) AS rank FROM z)
SELECT entity, date, round(ma_5, 6) AS ma_5, round(volume_ratio, 6) AS volume_ratio, round(z, 6) AS z, rank FROM r WHERE rank <= 5""")
def flagship(spark, sf_dir):
    """Moving average, volume ratio and 6-row momentum, scored by date, the five best names of each."""
    from pyspark.sql.window import Window

    from stratagrid.operators import technical as t

    df = panel(spark, sf_dir).withColumns({"ma_5": t.moving_averages((5,))["ma_5"], "volume_ratio": t.volumes()["volume_ratio"]}).where("mom is not null")
    x = Window.partitionBy("date")
    z = (F.col("mom") - F.avg("mom").over(x)) / F.greatest(F.coalesce(F.stddev_samp("mom").over(x), F.lit(1.0)), F.lit(1e-8))
    best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("z"), "entity"))
    return df.withColumn("z", z).withColumn("rank", best).where("rank <= 5").select("entity", "date", *(F.round(n, 6).alias(n) for n in ("ma_5", "volume_ratio", "z")), "rank")


@query("ud11_portfolio_returns", HEAD + """, o AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM m)),
f AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS r FROM m WHERE member AND isfinite(score) AND isfinite(fwd)),
k AS (SELECT *, greatest(1, least(n // 2, CAST(round_even(0.15::DOUBLE * n, 0) AS BIGINT))) AS k FROM f WHERE n >= 2),
b AS (SELECT date, max(n) AS n, max(k) AS k, avg(fwd) FILTER (r <= k) AS long, avg(fwd) FILTER (r > n - k) AS short FROM k GROUP BY date)
SELECT date, i % 5 AS phase, row_number() OVER (ORDER BY i % 5, date) - 1 AS place, n, k, round(long, 6) AS long, round(short, 6) AS short, round(long - short, 6) AS spread FROM b JOIN o USING (date)""")
def portfolio_returns(spark, sf_dir):
    from stratagrid.operators.evaluation import portfolio_returns as books

    out = books(panel(spark, sf_dir), "score", "fwd", 5, 0.15, F.col("member"))
    return out.select("date", *(F.col(c).cast("long").alias(c) for c in ("phase", "place", "n", "k")), *(F.round(c, 6).alias(c) for c in ("long", "short", "spread")))
