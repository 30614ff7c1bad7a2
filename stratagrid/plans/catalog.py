"""Queries of the channel catalog: line items stand for the sources, under the channels' own columns."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratagrid.functions.windows import returns
from stratagrid.operators import catalog as cat
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS, SO_FAR, E
from stratagrid.session import shared_dir, table

KINDS = {c.name: c for c in cat.CHANNELS}
#: Columns of the channels that take all a source has.
OPEN = {
    "capital_flow": ("main_net_inflow", "inflow_streak"), "block_trade": ("bt_value", "bt_count"), "shareholder": ("holder_num", "avg_hold"), "lockup": ("lockup_ratio",),
    "dividend": ("dividend_yield",), "board": ("board_heat", "board_count"), "sector": ("sector_flow", "sector_quadrant"), "concept": ("concept_heat", "concept_count"),
    "limit_up": ("limit_up_heat",), "pledge": ("pledge_ratio",), "index_membership": ("index_weight",),
}
EVENT_ROWS, STATE_ROWS = "l_returnflag = 'R'", "l_linestatus = 'O' AND l_discount > 0.07"


def names(ch: cat.Channel) -> list[str]:
    columns = ch.columns or OPEN[ch.name]
    return [c for c in columns if ch.name != "market_env" or c not in cat.ACCOUNT]


def amount(c: str, k: int) -> str:
    """The k-th column of a source, whole numbers throughout."""
    return {"flag": "true", "count": f"CAST(count(*) + {k} AS INT)", "value": f"CAST(sum(CAST(l_quantity AS DOUBLE)) * {k + 1} AS DOUBLE)"}[cat.kind(c)]


def source_sql(ch: cat.Channel) -> str:
    """The source in SQL that both engines take."""
    keys = "CAST(l_shipdate AS DATE) AS date" if ch.market_wide else "l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date"
    by = "CAST(l_shipdate AS DATE)" if ch.market_wide else "l_suppkey, CAST(l_shipdate AS DATE)"
    return f"SELECT {keys}, " + ", ".join(f"{amount(c, k)} AS {c}" for k, c in enumerate(names(ch))) + f" FROM lineitem WHERE {STATE_ROWS if ch.state else EVENT_ROWS} GROUP BY {by}"


def source(spark, sf_dir: str, ch: cat.Channel):
    text = source_sql(ch).replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"))


def expected(ch: cat.Channel) -> str:
    """What the channel's rules say, in SQL: fill, lag and age."""
    columns, z = names(ch), {"flag": "false", "count": "0", "value": "0.0"}
    using = "date" if ch.market_wide else "entity, date"
    head = f"WITH bars AS ({BARS}), src AS ({source_sql(ch)}), j AS (SELECT bars.entity, bars.date, " + ", ".join(columns) + f" FROM bars LEFT JOIN src USING ({using}))"
    late = lambda x, zero: f"coalesce(lag({x}) OVER {E}, {zero})" if ch.lag else f"coalesce({x}, {zero})"
    if not ch.state:
        return head + " SELECT entity, date, " + ", ".join(f"{late(f'coalesce({c}, {z[cat.kind(c)]})', z[cat.kind(c)])} AS {c}" for c in columns) + " FROM j"
    values = [c for c in columns if cat.kind(c) == "value"]
    seen = " OR ".join(f"{c} IS NOT NULL" for c in values)
    held = ", ".join(f"last_value({c} IGNORE NULLS) OVER {SO_FAR} AS {c}" if c in values else c for c in columns)
    n = ch.name
    return head + f""", s AS (SELECT *, CASE WHEN {seen} THEN date END AS seen FROM j),
h AS (SELECT entity, date, {held}, max(seen) OVER {SO_FAR} AS l, min(seen) OVER {SO_FAR} AS f FROM s)
SELECT entity, date, {", ".join(f"{late(c, z[cat.kind(c)])} AS {c}" for c in columns)},
CAST({late("date_diff('day', l, date)", "0")} AS INT) AS {n}_staleness_days, {late("l IS NOT NULL", "false")} AS {n}_has_ever_observed,
CAST({late("date_diff('day', f, date)", "0")} AS INT) AS {n}_days_since_first_available, {late(f"coalesce(date_diff('day', l, date) > {ch.stale_after}, false)", "false")} AS {n}_is_stale FROM h"""


def channel_query(row: str, name: str):
    ch = KINDS[name]

    @query(f"{row}_{name}", expected(ch))
    def one(spark, sf_dir):
        bars = daily(spark, sf_dir).select("entity", "date")
        return cat.merged(bars, {name: source(spark, sf_dir, ch)}, names=(name,))


for _row, _name in {
    "jn02": "sentiment", "jn03a": "announcements", "jn03b": "etf_flow", "jn03c": "comment", "jn03d": "capital_flow", "jn03e": "block_trade", "jn03f": "lockup", "jn03g": "dividend", "jn03h": "board", "jn03i": "sector",
    "jn03j": "concept", "jn03k": "limit_up", "jn03l": "index_membership", "jn04a": "margin", "jn04b": "northbound", "jn04c": "valuation", "jn04d": "shareholder", "jn04e": "pledge", "jn04g": "macro", "jn04h": "market_env",
    "jn04i": "industry", "jn07": "earnings",
}.items():
    channel_query(_row, _name)


SEATS = "SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS net_amount, CAST(l_quantity * 2 AS DOUBLE) AS buy_amount, CAST(l_quantity AS DOUBLE) AS sell_amount, CASE WHEN l_linenumber = 1 THEN '日振幅' WHEN l_linenumber = 2 THEN '连续三日跌幅' END AS lhb_reason FROM lineitem WHERE l_returnflag = 'R'"


@query("jn03m_dragon_tiger", f"""WITH bars AS ({BARS}), seats AS ({SEATS}),
a AS (SELECT entity, date, sum(net_amount) AS net, sum(buy_amount) / (sum(buy_amount) + sum(sell_amount) + 1) AS ratio, CAST(max(lhb_reason = '日振幅') AS DOUBLE) AS wave, CAST(max(lhb_reason = '连续三日跌幅') AS DOUBLE) AS falls FROM seats GROUP BY 1, 2),
j AS (SELECT bars.entity, bars.date, coalesce(net, 0) AS net, coalesce(ratio, 0) AS ratio, CASE WHEN net IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS there, coalesce(wave, 0) AS wave, coalesce(falls, 0) AS falls FROM bars LEFT JOIN a USING (entity, date)),
k AS (SELECT entity, date, coalesce(lag(net) OVER {E}, 0) AS lhb_net_amount, coalesce(lag(ratio) OVER {E}, 0) AS lhb_buy_ratio, coalesce(lag(there) OVER {E}, 0) AS lhb_present, coalesce(lag(wave) OVER {E}, 0) AS lhb_is_wave, coalesce(lag(falls) OVER {E}, 0) AS lhb_is_sustained, coalesce(lag(falls) OVER {E}, 0) AS lhb_is_drop FROM j)
SELECT *, CAST(sum(lhb_present) OVER (PARTITION BY entity ORDER BY date ROWS 4 PRECEDING) AS INT) AS lhb_count_5d FROM k""")
def dragon_tiger(spark, sf_dir):
    seats = spark.sql(SEATS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return cat.merged(daily(spark, sf_dir).select("entity", "date"), {"dragon_tiger": seats})


FACTS = "SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS disclose_date, CAST(sum(l_quantity) AS DOUBLE) AS roe, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS DOUBLE) AS eps FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.07 GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"


@query("jn04f_jn09_fundamental", f"""WITH bars AS ({BARS}), facts AS ({FACTS}),
u AS (SELECT entity, date, 1 AS bar, NULL::DOUBLE AS roe, NULL::DOUBLE AS eps FROM bars UNION ALL SELECT entity, disclose_date, 0, roe, eps FROM facts),
v AS (SELECT entity, date, bar, last_value(roe IGNORE NULLS) OVER w AS roe, last_value(eps IGNORE NULLS) OVER w AS eps FROM u WINDOW w AS (PARTITION BY entity ORDER BY date, bar ROWS UNBOUNDED PRECEDING)),
j AS (SELECT *, CASE WHEN roe IS NOT NULL OR eps IS NOT NULL THEN date END AS seen FROM v WHERE bar = 1),
h AS (SELECT entity, date, roe, eps, max(seen) OVER {SO_FAR} AS l, min(seen) OVER {SO_FAR} AS f FROM j)
SELECT entity, date, coalesce(lag(roe) OVER {E}, 0) AS roe, coalesce(lag(eps) OVER {E}, 0) AS eps, CAST(coalesce(lag(date_diff('day', l, date)) OVER {E}, 0) AS INT) AS fundamental_staleness_days, coalesce(lag(l IS NOT NULL) OVER {E}, false) AS fundamental_has_ever_observed,
CAST(coalesce(lag(date_diff('day', f, date)) OVER {E}, 0) AS INT) AS fundamental_days_since_first_available, coalesce(lag(date_diff('day', l, date) > 120) OVER {E}, false) AS fundamental_is_stale FROM h""")
def fundamental(spark, sf_dir):
    facts = spark.sql(FACTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return cat.merged(daily(spark, sf_dir).select("entity", "date"), {"fundamental": facts})


DRIVEN = ("announcements", "margin", "comment", "block_trade", "macro", "pledge")


@query("jn05_merge_driver", "SELECT * FROM (" + f"SELECT entity, date, close FROM ({BARS})) " + " ".join(f"JOIN ({expected(KINDS[n])}) USING (entity, date)" for n in DRIVEN))
def merge_driver(spark, sf_dir):
    sources = {n: source(spark, sf_dir, KINDS[n]) for n in reversed(DRIVEN)}
    return cat.merged(daily(spark, sf_dir).select("entity", "date", "close"), sources)


SECTORS = "SELECT CAST(l_shipdate AS DATE) AS date, s_nationkey AS sector_code, CAST(sum(l_quantity) AS DOUBLE) AS sector_relative_strength, CAST(count(*) AS DOUBLE) AS sector_alpha, CAST(sum(l_quantity) - 40 AS DOUBLE) AS sector_rrg_x, CAST(3 - count(*) AS DOUBLE) AS sector_rrg_y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O' GROUP BY CAST(l_shipdate AS DATE), s_nationkey"


@query("jn16_sector_broadcast", f"""WITH bars AS ({BARS}), sec AS ({SECTORS}), r AS (SELECT entity, date, s_nationkey AS sector_code FROM bars JOIN supplier ON s_suppkey = entity)
SELECT entity, date, sector_code, coalesce(sector_relative_strength, 0) AS sector_relative_strength, coalesce(sector_alpha, 0) AS sector_alpha, sector_rrg_x, sector_rrg_y,
CAST(CASE WHEN sector_rrg_x > 0 THEN 2 ELSE 0 END + CASE WHEN sector_rrg_y > 0 THEN 1 ELSE 0 END AS INT) AS sector_rrg_quadrant FROM r LEFT JOIN sec USING (date, sector_code)""")
def sector_broadcast(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    rows = daily(spark, sf_dir).select("entity", "date").join(supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector_code")), "entity")
    sectors = spark.sql(SECTORS.replace("FROM lineitem JOIN supplier", "FROM {lineitem} JOIN {supplier}"), lineitem=table(spark, sf_dir, "lineitem"), supplier=supplier)
    return cat.sector_broadcast(rows, sectors)


@query("jn19_first_of_day", f"""WITH bars AS ({BARS}), f AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, l_quantity AS sealed, l_tax AS broken FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1)
SELECT entity, date, sealed, broken FROM bars LEFT JOIN f USING (entity, date)""")
def first_of_day(spark, sf_dir):
    meta = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("sealed"), F.col("l_tax").alias("broken"))
    return cat.first_of(daily(spark, sf_dir).select("entity", "date"), meta, ["sealed", "broken"], ["l_orderkey", "l_linenumber"])


@query("jn21_close_enriched", f"WITH bars AS ({BARS}), ev AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT entity, date, returned, close FROM ev LEFT JOIN bars USING (entity, date)")
def close_enriched(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    ev = li.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("returned"))
    return ev.join(daily(spark, sf_dir).select("entity", "date", "close"), ["entity", "date"], "left")


@query("tk04_leader", f"""WITH bars AS ({BARS}), r AS (SELECT entity, date, close / lag(close) OVER {E} - 1 AS ret FROM bars), s AS (SELECT r.*, s_nationkey AS sector FROM r JOIN supplier ON s_suppkey = entity WHERE ret IS NOT NULL)
SELECT date, sector, entity AS leader, round(ret, 8) AS ret FROM s QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY ret DESC, entity) = 1""")
def leader(spark, sf_dir):
    rows = daily(spark, sf_dir).select("entity", "date", returns("close").alias("ret")).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector")), "entity")
    return cat.leaders(rows, ["date", "sector"], "ret").withColumn("ret", F.round("ret", 8))


@query("so06_global_sort", f"SELECT date, entity, close FROM ({BARS}) ORDER BY date, entity")
def global_sort(spark, sf_dir):
    return daily(spark, sf_dir).select("date", "entity", "close").orderBy("date", "entity")


@query("sc22_23_features", f"WITH bars AS ({BARS}), m AS ({expected(KINDS['margin'])}) SELECT entity, date, close, volume FROM bars JOIN m USING (entity, date)")
def features(spark, sf_dir):
    """Stored features, read without lagged columns, topics and a channel that is off."""
    bars = daily(spark, sf_dir).select("entity", "date", "close", "volume")
    made = cat.merged(bars, {"margin": source(spark, sf_dir, KINDS["margin"])}).withColumns({"close_lag1": F.col("close"), "topic_entropy": F.lit(0.0)})
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    cat.save_features(made, path)
    return cat.load_features(spark, path, off=("margin",))
