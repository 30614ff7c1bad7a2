"""Queries of joins, fills and intervals: orders and line items stand for side channels of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import channels as ch
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS, SO_FAR, E
from stratagrid.session import table

#: Returned lines as an event channel, disputed ones (linestatus O, discount above 0.07) as a state channel.
AUX = f"""WITH bars AS ({BARS}),
ev AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS returned, count(*)::DOUBLE AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
st AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, max(l_tax) AS tax FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.07 GROUP BY 1, 2)"""


def line_aux(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"entity": F.col("l_suppkey"), "date": F.col("l_shipdate").cast("date")})
    ev = li.where("l_returnflag = 'R'").groupBy("entity", "date").agg(F.sum("l_quantity").alias("returned"), F.count("*").cast("double").alias("n_returned"))
    st = li.where("l_linestatus = 'O' and l_discount > 0.07D").groupBy("entity", "date").agg(F.max("l_tax").alias("tax"))
    return ev, st


@query("jn01_event_channel", AUX + f"""
SELECT entity, date, coalesce(lag(coalesce(returned, 0)) OVER {E}, 0) AS returned, coalesce(lag(coalesce(n_returned, 0)) OVER {E}, 0) AS n_returned FROM bars LEFT JOIN ev USING (entity, date)""")
def event_channel(spark, sf_dir):
    ev, _ = line_aux(spark, sf_dir)
    return ch.event_channel(daily(spark, sf_dir), ev, ["returned", "n_returned"]).select("entity", "date", "returned", "n_returned")


@query("jn02_effective_channel", AUX + " SELECT entity, date, coalesce(returned, 0) AS returned FROM bars LEFT JOIN ev USING (entity, date)")
def effective_channel(spark, sf_dir):
    ev, _ = line_aux(spark, sf_dir)
    return ch.event_channel(daily(spark, sf_dir), ev, ["returned"], lag=0).select("entity", "date", "returned")


@query("jn04_state_channel", AUX + f""",
j AS (SELECT entity, date, tax, CASE WHEN tax IS NOT NULL THEN date END AS seen FROM bars LEFT JOIN st USING (entity, date)),
h AS (SELECT entity, date, last_value(tax IGNORE NULLS) OVER {SO_FAR} AS tax, max(seen) OVER {SO_FAR} AS l, min(seen) OVER {SO_FAR} AS f FROM j),
g AS (SELECT entity, date, lag(tax) OVER {E} AS tax, lag(l) OVER {E} AS l, lag(f) OVER {E} AS f FROM h)
SELECT entity, date, tax, date_diff('day', l, date)::INT AS days_since, l IS NOT NULL AS ever_seen, date_diff('day', f, date)::INT AS days_since_first, coalesce(date_diff('day', l, date) > 40, true) AS is_stale FROM g""")
def state_channel(spark, sf_dir):
    _, st = line_aux(spark, sf_dir)
    return ch.state_channel(daily(spark, sf_dir), st, ["tax"], stale_after=40).select("entity", "date", "tax", "days_since", "ever_seen", "days_since_first", "is_stale")


@query("jn06_as_of", AUX + " SELECT b.entity, b.date, st.tax AS tax FROM bars b ASOF LEFT JOIN st ON b.entity = st.entity AND b.date >= st.date")
def as_of(spark, sf_dir):
    _, st = line_aux(spark, sf_dir)
    return ch.as_of(daily(spark, sf_dir).select("entity", "date"), st, ["tax"])


@query("jn08_expiring_as_of", AUX + " SELECT b.entity, b.date, CASE WHEN date_diff('day', st.date, b.date) <= 30 THEN st.tax END AS tax FROM bars b ASOF LEFT JOIN st ON b.entity = st.entity AND b.date >= st.date")
def expiring_as_of(spark, sf_dir):
    _, st = line_aux(spark, sf_dir)
    return ch.expiring_as_of(daily(spark, sf_dir).select("entity", "date"), st, ["tax"], 30)


#: Spells of suppliers: months with more than four shipping days, cut at gaps.
SPELLS = f"""WITH bars AS ({BARS}),
mo AS (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS month FROM bars GROUP BY 1, 2 HAVING count(*) > 6),
g AS (SELECT *, CASE WHEN lag(month) OVER (PARTITION BY entity ORDER BY month) >= month - INTERVAL 1 MONTH THEN 0 ELSE 1 END AS fresh FROM mo),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY month) AS island FROM g),
s AS (SELECT entity, min(month) AS in_date, CASE WHEN max(month) < (SELECT max(month) FROM mo) THEN CAST(max(month) + INTERVAL 1 MONTH AS DATE) END AS out_date FROM i GROUP BY entity, island)"""


def membership(spark, sf_dir):
    months = daily(spark, sf_dir).groupBy("entity", F.trunc("date", "month").alias("month")).agg(F.count("*").alias("n")).where("n > 6").select("entity", "month")
    return ch.spells(months)


@query("md03_spells", SPELLS + " SELECT * FROM s")
def spells(spark, sf_dir):
    return membership(spark, sf_dir)


@query("jn10_member_flag", SPELLS + " SELECT b.entity, b.date, EXISTS (SELECT 1 FROM s WHERE s.entity = b.entity AND s.in_date <= b.date AND (s.out_date IS NULL OR b.date < s.out_date)) AS is_member FROM bars b")
def member_flag(spark, sf_dir):
    return ch.member_flag(daily(spark, sf_dir).select("entity", "date"), membership(spark, sf_dir))


@query("jn12_member_counts", SPELLS + f""",
n AS (SELECT b.entity, b.date, count(s.entity) AS n_covering FROM bars b LEFT JOIN s ON s.entity = b.entity AND s.in_date <= b.date AND (s.out_date IS NULL OR b.date < s.out_date) GROUP BY 1, 2),
d AS (SELECT *, n_covering - lag(n_covering) OVER {E} AS d FROM n)
SELECT entity, date, n_covering, n_covering > 0 AS covered, CASE WHEN count(d) OVER w = 30 THEN sum(d) OVER w ELSE 0 END::BIGINT AS change FROM d WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 29 PRECEDING)""")
def member_counts(spark, sf_dir):
    return ch.member_counts(daily(spark, sf_dir).select("entity", "date"), membership(spark, sf_dir)).select("entity", "date", "n_covering", "covered", F.col("change").cast("long").alias("change"))


@query("jn14_in_pool", AUX + " SELECT b.entity, b.date, ev.entity IS NOT NULL AS in_pool FROM bars b LEFT JOIN ev USING (entity, date)")
def in_pool(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return ch.in_pool(daily(spark, sf_dir).select("entity", "date"), li.select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date")))


@query("jn15_date_broadcast", f"WITH bars AS ({BARS}), o AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1) SELECT entity, date, orders, value FROM bars LEFT JOIN o USING (date)")
def date_broadcast(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    return ch.date_broadcast(daily(spark, sf_dir).select("entity", "date"), o, ["orders", "value"])


@query("jn17_valid_from", f"WITH bars AS ({BARS}) SELECT entity, date, CASE WHEN date >= DATE '1997-01-01' + CAST(s_suppkey % 365 AS INT) THEN s_nationkey END AS sector FROM bars LEFT JOIN supplier ON s_suppkey = entity")
def valid_from(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector"), F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 365).cast("int")).alias("valid_from"))
    return ch.valid_from(daily(spark, sf_dir).select("entity", "date"), m, ["sector"])


@query("jn20_membership_inner", f"WITH bars AS ({BARS}) SELECT n_name AS sector, count(*) AS rows, sum(volume) AS volume FROM bars JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def membership_inner(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    names = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("sector"))
    return daily(spark, sf_dir).join(names, "entity").groupBy("sector").agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))


@query("jn25_anti", AUX + " SELECT entity, date FROM bars ANTI JOIN ev USING (entity, date)")
def anti(spark, sf_dir):
    ev, _ = line_aux(spark, sf_dir)
    return daily(spark, sf_dir).select("entity", "date").join(ev, ["entity", "date"], "left_anti")


@query("wo43_rebased", f"""WITH bars AS ({BARS}), p AS (SELECT entity, date, close FROM bars WHERE date >= DATE '1998-01-01'), b AS (SELECT entity, date, close * (1 + entity % 7) AS close FROM bars WHERE date < DATE '1998-07-01'),
r AS (SELECT entity, median(p.close / b.close) AS r FROM p JOIN b USING (entity, date) GROUP BY 1)
SELECT entity, date, round(close, 8) AS close FROM (SELECT * FROM p UNION ALL SELECT b.entity, b.date, b.close * r FROM b JOIN r USING (entity) ANTI JOIN p ON p.entity = b.entity AND p.date = b.date)""")
def rebased(spark, sf_dir):
    d = daily(spark, sf_dir).select("entity", "date", "close")
    return ch.rebased(d.where("date >= date '1998-01-01'"), d.where("date < date '1998-07-01'").withColumn("close", F.col("close") * (1 + F.col("entity") % 7))).withColumn("close", F.round("close", 8))


@query("sc02_last_write_wins", f"WITH bars AS ({BARS}) SELECT entity, date, CASE WHEN date >= DATE '2000-01-01' THEN volume + 1 ELSE volume END AS volume FROM bars")
def last_write_wins(spark, sf_dir):
    d = daily(spark, sf_dir).select("entity", "date", "volume")
    return ch.last_write_wins(d, d.where("date >= date '2000-01-01'").withColumn("volume", F.col("volume") + 1), ["entity", "date"])


@query("sc07_replaced_range", f"WITH bars AS ({BARS}) SELECT entity, date, CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' THEN -volume ELSE volume END AS volume FROM bars")
def replaced_range(spark, sf_dir):
    d = daily(spark, sf_dir).select("entity", "date", "volume")
    new = d.where("date between date '1996-01-01' and date '1996-12-31'").withColumn("volume", -F.col("volume"))
    return ch.replaced_range(d, new, "1996-01-01", "1996-12-31")


@query("sc06_segments", f"""WITH bars AS ({BARS}), k AS (SELECT *, volume > 25 AS big FROM bars), i AS (SELECT *, CASE WHEN lag(big) OVER {E} = big THEN 0 ELSE 1 END AS f FROM k),
j AS (SELECT *, sum(f) OVER {SO_FAR} AS island FROM i) SELECT entity, big, min(date) AS start, max(date) AS "end", count(*) AS rows FROM j GROUP BY entity, big, island""")
def segments(spark, sf_dir):
    return ch.segments(daily(spark, sf_dir).withColumn("big", F.col("volume") > 25), "big")


@query("md04_changes_to_intervals", f"""WITH bars AS ({BARS}), k AS (SELECT entity, date, CAST(floor(close / 500) AS BIGINT) AS band FROM bars), c AS (SELECT * FROM k QUALIFY lag(band) OVER {E} IS DISTINCT FROM band)
SELECT entity, band, date AS in_date, lead(date) OVER {E} AS out_date FROM c""")
def changes_to_intervals(spark, sf_dir):
    k = daily(spark, sf_dir).select("entity", "date", F.floor(F.col("close") / 500).alias("band"))
    return ch.changes_to_intervals(k, "band")


@query("pf05_on_calendar", f"WITH bars AS ({BARS}), cal AS (SELECT date FROM bars GROUP BY 1 HAVING count(*) >= 3) SELECT entity, date, close FROM bars WHERE date IN (SELECT date FROM cal)")
def on_calendar(spark, sf_dir):
    d = daily(spark, sf_dir)
    cal = d.groupBy("date").agg(F.count("*").alias("n")).where("n >= 3")
    return ch.on_calendar(d, cal, "volume").select("entity", "date", "close")


@query("wo22_bounded_fill", AUX + f""",
j AS (SELECT entity, date, tax, row_number() OVER {E} AS rn FROM bars LEFT JOIN st USING (entity, date)), k AS (SELECT *, max(CASE WHEN tax IS NOT NULL THEN rn END) OVER {SO_FAR} AS seen_at, last_value(tax IGNORE NULLS) OVER {SO_FAR} AS held FROM j)
SELECT entity, date, CASE WHEN rn - seen_at <= 5 THEN held END AS tax FROM k""")
def bounded_fill(spark, sf_dir):
    _, st = line_aux(spark, sf_dir)
    return ch.bounded_fill(daily(spark, sf_dir).select("entity", "date"), st, "tax", 5)


@query("so05_distinct_members", SPELLS + " SELECT DISTINCT entity FROM s")
def distinct_members(spark, sf_dir):
    return membership(spark, sf_dir).select("entity").distinct()


@query("so02_03_04_set_operations", """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for k, df in named.items():
        one = df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")).select("kind", "n")
        out = one if out is None else out.unionByName(one)
    return out
