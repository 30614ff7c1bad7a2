"""Queries of grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import aggregates as a
from stratagrid.operators import evaluation as ev
from stratagrid.operators.technical import prepared
from stratagrid.plans.bars import daily
from stratagrid.plans.cross_section import HEAD, panel
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS, PREPARED, E
from stratagrid.session import table

LINES = "SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS entity, l_discount AS premium, l_extendedprice AS amount, l_quantity AS volume, l_returnflag || l_linestatus AS note, * FROM lineitem"


def lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("entity"), F.col("l_discount").alias("premium"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("volume"), F.concat("l_returnflag", "l_linestatus").alias("note"), "l_tax", "l_partkey", "l_orderkey", "l_linenumber")


@query("ag01_block_days", f"""WITH e AS ({LINES}) SELECT date, entity, count(*) AS n, round(avg(premium), 6) AS premium, round(sum(amount), 3) AS amount, sum(volume) AS volume, round(sum(premium * amount) / sum(amount), 6) AS vwap_premium,
bool_or(regexp_matches(note, '^R')) AS returned, bool_or(regexp_matches(note, 'O$')) AS open FROM e GROUP BY 1, 2""")
def block_days(spark, sf_dir):
    out = a.block_days(lines(spark, sf_dir), "premium", "amount", "volume", "note", {"returned": "^R", "open": "O$"})
    return out.withColumns({"premium": F.round("premium", 6), "amount": F.round("amount", 3), "vwap_premium": F.round("vwap_premium", 6)})


@query("ag02_ranked_seats", f"WITH e AS ({LINES}) SELECT date, entity, sum(b) - sum(s) AS net, round(sum(b) / (sum(b) + sum(s) + 1), 6) AS buy_share, 1 AS listed FROM (SELECT *, CASE WHEN note[1] = 'R' THEN 0 ELSE volume END AS b, CASE WHEN note[1] = 'R' THEN volume ELSE 0 END AS s FROM e) GROUP BY 1, 2")
def ranked_seats(spark, sf_dir):
    e = lines(spark, sf_dir).withColumns({"b": F.when(F.col("note").startswith("R"), 0.0).otherwise(F.col("volume")), "s": F.when(F.col("note").startswith("R"), F.col("volume")).otherwise(0.0)})
    return a.ranked_seats(e, "b", "s").withColumn("buy_share", F.round("buy_share", 6))


@query("ag03_long_to_wide", f"WITH e AS ({LINES}) SELECT date, entity, max(CASE WHEN note[1] = 'R' THEN 1 ELSE 0 END) AS cb_r, round(avg(premium), 6) AS premium, min(note) AS note FROM e GROUP BY 1, 2")
def long_to_wide(spark, sf_dir):
    e = lines(spark, sf_dir).withColumn("cb_r", F.col("note").startswith("R").cast("int"))
    return a.long_to_wide(e, ["cb_r"], ["premium"], ["note"]).withColumn("premium", F.round("premium", 6))


@query("ag04_dispersion", PREPARED + """, b AS (SELECT date, count(*) FILTER (ret > 0) / nullif(count(ret), 0) AS share_up, avg(ret) AS mean, stddev_samp(ret) AS dev, max(ret) AS top, min(ret) AS bottom, skewness(ret) AS skew, count(ret) AS n FROM p GROUP BY 1)
SELECT date, round(share_up, 6) AS share_up, round(mean, 6) AS mean, round(dev, 6) AS dev, round(top, 6) AS top, round(bottom, 6) AS bottom, round(CASE WHEN n >= 3 THEN skew END, 6) AS skew,
round(CASE WHEN count(dev) OVER w = 20 THEN stddev_samp(dev) OVER w END, 6) AS dev_of_dev FROM b WHERE n > 2 WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)""")
def dispersion(spark, sf_dir):
    df = prepared(daily(spark, sf_dir))
    some = df.groupBy("date").agg(F.count("ret").alias("n")).where("n > 2").select("date")
    out = a.dispersion(df.join(some, "date"), "ret")
    return out.select("date", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("ag06_breadth", PREPARED + """, b AS (SELECT date, sum(volume) AS turnover, count(*) FILTER (ret > 0) / CAST(nullif(count(ret), 0) AS DOUBLE) AS advance FROM p GROUP BY 1)
SELECT date, turnover, round(advance, 6) AS advance, round(CASE WHEN count(*) OVER w = 20 THEN (turnover - avg(turnover) OVER w) / nullif(stddev_samp(turnover) OVER w, 0) END, 6) AS turnover_z FROM b WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)""")
def breadth(spark, sf_dir):
    return a.breadth(prepared(daily(spark, sf_dir)), "volume", "ret").withColumns({"advance": F.round("advance", 6), "turnover_z": F.round("turnover_z", 6)})


@query("ag14_flow_by_group", HEAD + " SELECT date, sector, sum(volume * sign(ret)) AS flow, count(DISTINCT entity) AS items FROM m WHERE ret IS NOT NULL GROUP BY 1, 2")
def flow_by_group(spark, sf_dir):
    return a.flow_by_group(panel(spark, sf_dir).where("ret is not null"), "sector", "volume", "ret", "entity")


@query("ag15_ladder", f"""WITH e AS ({LINES}) SELECT date, round(avg(CASE WHEN note[1] = 'R' THEN 100.0 ELSE 0 END), 6) AS break_rate, max(l_linenumber) AS top, round(avg(CASE WHEN premium >= 0.098 THEN 1.0 ELSE 0 END), 6) AS advance,
count(*) FILTER (l_linenumber = 2) AS h2, count(*) FILTER (l_linenumber = 3) AS h3, count(*) FILTER (l_linenumber = 4) AS h4, count(*) FILTER (l_linenumber = 5) AS h5, count(*) FILTER (l_linenumber >= 6) AS h6_up FROM e GROUP BY 1""")
def ladder(spark, sf_dir):
    return a.ladder(lines(spark, sf_dir), "l_linenumber", F.col("note").startswith("R"), "premium", 0.098).withColumns({"break_rate": F.round("break_rate", 6), "advance": F.round("advance", 6)})


@query("ag16_pool_counts", f"WITH e AS ({LINES}) SELECT date, count(*) AS n FROM e WHERE note = 'RF' GROUP BY 1")
def pool_counts(spark, sf_dir):
    return lines(spark, sf_dir).where("note = 'RF'").groupBy("date").agg(F.count("*").alias("n"))


@query("ag17_vocabulary", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, p_brand LIMIT 10")
def vocabulary(spark, sf_dir):
    return a.vocabulary(table(spark, sf_dir, "part"), "p_brand", 5, 10)


def branded(spark, sf_dir):
    return lines(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("board"), F.col("p_retailprice").alias("mom")), "l_partkey")


BRANDED = f"WITH e AS ({LINES}), b AS (SELECT e.*, p_brand AS board, p_retailprice AS mom FROM e JOIN part ON p_partkey = l_partkey)"


@query("ag18_multi_hot", BRANDED + ", v AS (SELECT board, row_number() OVER (ORDER BY count(*) DESC, board) - 1 AS j FROM b GROUP BY board HAVING count(*) >= 5) SELECT date, entity, " + ", ".join(f"max(CASE WHEN j = {j} THEN 1 ELSE 0 END) AS cb_{j}" for j in range(5)) + " FROM b LEFT JOIN v USING (board) GROUP BY 1, 2")
def multi_hot(spark, sf_dir):
    b = branded(spark, sf_dir)
    return a.multi_hot(b, "board", [r["board"] for r in a.vocabulary(b, "board", 5, 5).collect()])


@query("ag19_concepts", BRANDED + """, k AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct FROM b)
SELECT date, entity, count(board) AS boards, round(avg(mom), 6) AS mean_mom, max(mom) AS max_mom, count(*) FILTER (pct > 0.9) AS hot, round(avg(pct), 6) AS heat FROM k GROUP BY 1, 2""")
def concepts(spark, sf_dir):
    return a.concepts(branded(spark, sf_dir), "board", "mom").withColumns({"mean_mom": F.round("mean_mom", 6), "heat": F.round("heat", 6)})


@query("ag20_mode", BRANDED + ", n AS (SELECT entity, board, count(*) AS n FROM b GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, board) = 1")
def mode_of(spark, sf_dir):
    return a.mode_of(branded(spark, sf_dir), "entity", "board")


COLUMNS = ["ret", "dc", "volume", "lvr"]
LONG = "l AS (" + " UNION ALL ".join(f"SELECT entity, date, '{c}' AS feature, {c} AS value FROM p" for c in COLUMNS) + ")"


@query("ag21_22_sparsity", PREPARED + f""", {LONG}, b AS (SELECT feature, entity, count(*) FILTER (coalesce(value, 0) <> 0) AS nz, count(*) AS n, coalesce(CAST(min(value) = max(value) AS INT), 1) AS flat FROM l GROUP BY 1, 2)
SELECT feature, round(sum(nz) / sum(n), 6) AS nonzero, round(avg(flat), 6) AS flat_share, CASE WHEN sum(nz) / sum(n) < 0.01 THEN 'dead' WHEN sum(nz) / sum(n) < 0.2 THEN 'sparse' ELSE 'dense' END AS tier FROM b GROUP BY 1""")
def sparsity(spark, sf_dir):
    return a.sparsity(prepared(daily(spark, sf_dir)), COLUMNS).withColumns({"nonzero": F.round("nonzero", 6), "flat_share": F.round("flat_share", 6)})


@query("ag23_coverage", PREPARED + " SELECT entity, count(*) AS days, count(ret) AS with_data, round(count(ret) / count(*), 6) AS share, round(avg(ret), 6) AS mean, round(stddev_samp(ret), 6) AS dev FROM p GROUP BY 1")
def coverage(spark, sf_dir):
    return a.coverage(prepared(daily(spark, sf_dir)), "ret").withColumns({c: F.round(c, 6) for c in ("share", "mean", "dev")})


@query("ag24_quality", PREPARED + f", {LONG} SELECT feature, round(1 - count(value) / count(*), 6) AS missing, count(*) FILTER (isinf(value)) AS infinite, round(count(DISTINCT value) / count(*), 4) AS unique_share, CASE WHEN 1 - count(value) / count(*) > 0.5 THEN 'bad' WHEN 1 - count(value) / count(*) > 0.2 THEN 'poor' ELSE 'good' END AS tier FROM l WHERE feature IN ('volume', 'dc') GROUP BY 1")
def quality(spark, sf_dir):
    return a.quality(prepared(daily(spark, sf_dir)), ["volume", "dc"]).withColumns({"missing": F.round("missing", 6), "unique_share": F.round("unique_share", 4)})


HALVES = PREPARED + ", x AS (SELECT * FROM p WHERE date < DATE '1998-01-01'), y AS (SELECT * FROM p WHERE date >= DATE '1998-01-01')"


def halves(spark, sf_dir):
    p = prepared(daily(spark, sf_dir))
    return p.where("date < date '1998-01-01'"), p.where("date >= date '1998-01-01'")


@query("ag25_sigma_drift", HALVES + " SELECT f AS feature, round(s, 6) AS shift, s >= 3 AND n >= 10 AS drift FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS f, abs((SELECT avg({c}) FROM y) - (SELECT avg({c}) FROM x)) / (SELECT stddev_pop({c}) FROM x) AS s, least((SELECT count({c}) FROM x), (SELECT count({c}) FROM y)) AS n" for c in ("ret", "volume")) + ")")
def sigma_drift(spark, sf_dir):
    x, y = halves(spark, sf_dir)
    return a.sigma_drift(x, y, ["ret", "volume"]).withColumn("shift", F.round("shift", 6))


@query("ag26_ks", HALVES + """, v AS (SELECT close AS v, 1 AS a, 0 AS b FROM x UNION ALL SELECT close, 0, 1 FROM y), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY 1)
SELECT round(max(abs(ra / (SELECT count(*) FROM x) - rb / (SELECT count(*) FROM y))), 6) AS ks FROM (SELECT sum(a) OVER o AS ra, sum(b) OVER o AS rb FROM g WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING))""")
def ks(spark, sf_dir):
    x, y = halves(spark, sf_dir)
    return a.ks(x, y, "close").withColumn("ks", F.round("ks", 6))


@query("ag26_psi", HALVES + """, v AS (SELECT close AS v, 0 AS side FROM x UNION ALL SELECT close, 1 FROM y), e AS (SELECT quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM v),
k AS (SELECT side, e, least(len(e) - 2, len(list_filter(e, lambda q: q <= v)) - 1) AS k FROM v, e), b AS (SELECT k, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, max(e[k + 2] - e[k + 1]) AS width FROM k GROUP BY 1),
d AS (SELECT a / sum(a) OVER () / width + 1e-10 AS p, b / sum(b) OVER () / width + 1e-10 AS q FROM b) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM d""")
def psi(spark, sf_dir):
    x, y = halves(spark, sf_dir)
    return a.psi(x, y, "close").withColumn("psi", F.round("psi", 8))


@query("ag31_sector_median", HEAD + " SELECT date, sector, round(median(ret), 6) AS median FROM m GROUP BY 1, 2")
def sector_median(spark, sf_dir):
    return a.sector_median(panel(spark, sf_dir), "ret").withColumn("median", F.round("median", 6))


@query("ud24_relative_label", HEAD + " SELECT entity, date, round(fwd - median(fwd) OVER (PARTITION BY date, sector), 6) AS relative FROM m WHERE fwd IS NOT NULL")
def relative_label(spark, sf_dir):
    df = panel(spark, sf_dir).where("fwd is not null")
    med = a.sector_median(df, "fwd").select(F.col("date").alias("d"), F.col("sector").alias("s"), "median")
    return df.join(med, (F.col("date") == F.col("d")) & F.col("sector").eqNullSafe(F.col("s"))).select("entity", "date", F.round(F.col("fwd") - F.col("median"), 6).alias("relative"))


@query("md10_11_full_outer_series", """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, 1 AS opened, 0 AS shipped, 0 AS returned FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), 0, 1, 0 FROM lineitem UNION ALL SELECT CAST(l_shipdate AS DATE), 0, 0, 1 FROM lineitem WHERE l_returnflag = 'R')
SELECT date, sum(opened)::BIGINT AS opened, sum(shipped)::BIGINT AS shipped, sum(returned)::BIGINT AS returned FROM o GROUP BY 1""")
def full_outer_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    e = lines(spark, sf_dir)
    return a.full_outer_series({"opened": o, "shipped": e.select("date"), "returned": e.where("note like 'R%'").select("date")})


@query("md01_trailing_twelve", f"""WITH e AS ({LINES}), q AS (SELECT entity, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS report_date, year(date) AS y, sum(volume) AS v FROM e GROUP BY 1, 2, 3),
c AS (SELECT entity, report_date, sum(v) OVER (PARTITION BY entity, y ORDER BY report_date) AS eps FROM q),
f AS (SELECT c.*, last_value(CASE WHEN month(report_date) = 12 THEN eps END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fy FROM c)
SELECT f.entity, CAST(f.report_date AS DATE) AS report_date, CASE WHEN month(f.report_date) = 12 THEN greatest(f.eps, 0.001) WHEN fy IS NULL THEN NULL ELSE greatest(fy + f.eps - coalesce(g.eps, 0), 0.001) END AS ttm
FROM f LEFT JOIN c g ON g.entity = f.entity AND g.report_date = last_day(f.report_date - INTERVAL 1 YEAR)""")
def trailing_twelve(spark, sf_dir):
    from pyspark.sql.window import Window

    q = lines(spark, sf_dir).groupBy("entity", F.last_day(F.add_months(F.trunc("date", "quarter"), 2)).alias("report_date"), F.year("date").alias("y")).agg(F.sum("volume").alias("v"))
    c = q.select("entity", "report_date", F.sum("v").over(Window.partitionBy("entity", "y").orderBy("report_date")).alias("eps"))
    return a.trailing_twelve(c, "eps").select("entity", "report_date", "ttm")


@query("md18_refresh_plan", f"WITH bars AS ({BARS}), l AS (SELECT entity, max(date) AS stored FROM bars GROUP BY 1) SELECT entity, stored, stored + 1 AS next, entity % 4 AS shard FROM l WHERE stored < DATE '2001-11-01'")
def refresh_plan(spark, sf_dir):
    return a.refresh_plan(daily(spark, sf_dir), "2001-11-01")


@query("md16_last_session", f"WITH bars AS ({BARS}) SELECT max(date) AS session FROM bars WHERE date < DATE '2000-06-15'")
def last_session(spark, sf_dir):
    return daily(spark, sf_dir).where("date < date '2000-06-15'").agg(F.max("date").alias("session"))


@query("sc29_stratified_sample", "WITH k AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('7|' || s_suppkey), s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, s_nationkey FROM k WHERE r <= greatest(1, floor(n * 0.3))")
def stratified_sample(spark, sf_dir):
    return a.stratified_sample(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", 0.3, 7)


PRED = HEAD + ", c AS (SELECT CASE WHEN fwd > 0.3 THEN 2 WHEN fwd < -0.3 THEN 0 ELSE 1 END AS y, CASE WHEN score > 0.3 THEN 2 WHEN score < -0.3 THEN 0 ELSE 1 END AS g FROM m WHERE fwd IS NOT NULL AND score IS NOT NULL), n AS (SELECT y, g, count(*) AS n FROM c GROUP BY 1, 2)"


@query("ag27_28_classification", PRED + """, t AS (SELECT y AS k, sum(n)::DOUBLE AS t, sum(n) FILTER (y = g)::DOUBLE AS hit FROM n GROUP BY 1), gs AS (SELECT g AS k, sum(n)::DOUBLE AS p FROM n GROUP BY 1),
b AS (SELECT k, coalesce(t, 0) AS t, coalesce(hit, 0) AS hit, coalesce(p, 0) AS p FROM t FULL JOIN gs USING (k)),
s AS (SELECT sum(t) AS total, sum(hit) AS correct, avg(coalesce(hit / nullif(p, 0), 0)) AS pr, avg(coalesce(hit / nullif(t, 0), 0)) AS rc, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM b)
SELECT round(correct / total, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1, round((correct * total - tp) / sqrt((total * total - pp) * (total * total - tt)), 6) AS mcc FROM s""")
def classification(spark, sf_dir):
    cls = lambda c: F.when(F.col(c) > 0.3, 2).when(F.col(c) < -0.3, 0).otherwise(1)
    df = panel(spark, sf_dir).where("fwd is not null and score is not null").select(cls("fwd").alias("y"), cls("score").alias("g"))
    return ev.classification(df, "y", "g").select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "mcc")))


@query("ag29_30_fill_probability", HEAD + " SELECT date, count(*) FILTER (volume > 20) AS decided, round(count(*) FILTER (volume > 20 AND fwd IS NOT NULL) / nullif(count(*) FILTER (volume > 20), 0), 6) AS p_fill FROM m GROUP BY 1")
def fill_probability(spark, sf_dir):
    return ev.fill_probability(panel(spark, sf_dir), F.col("volume") > 20, F.col("fwd").isNotNull()).withColumn("p_fill", F.round("p_fill", 6))


BOOK = HEAD + """, pool AS (SELECT date, entity, score, greatest(-0.5, least(0.5, fwd)) / 20 AS f FROM m WHERE score IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS b, greatest(1, least(floor(n / 2.0), round_even(n * 0.2, 0))) AS k FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM pool)), r AS (SELECT date, avg(f) AS r FROM k WHERE b <= k GROUP BY 1)"""


def book(spark, sf_dir):
    """Daily returns of the best fifth by score, scaled down so that the curve stays finite."""
    from stratagrid.operators.cross_section import top_k

    pool = panel(spark, sf_dir).where("score is not null and fwd is not null").withColumn("f", F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("fwd"))) / 20)
    return top_k(pool, "score", 0.2).where("side = 'long'").groupBy("date").agg(F.avg("f").alias("r"))


CURVE = ", c AS (SELECT date, r, exp(sum(ln(1 + r)) OVER o) AS e FROM r WINDOW o AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), q AS (SELECT *, e / greatest(1, max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM c)"


@query("ud06_equity", BOOK + CURVE + " SELECT date, round(r, 8) AS r, round(e, 8) AS equity, round(dd, 8) AS drawdown FROM q")
def equity(spark, sf_dir):
    return ev.equity(book(spark, sf_dir)).select("date", *(F.round(c, 8).alias(c) for c in ("r", "equity", "drawdown")))


@query("ud05_06_risk", BOOK + CURVE + """, s AS (SELECT count(*) AS days, avg(r) AS mean, stddev_samp(r) AS dev, sqrt(avg(power(least(r, 0), 2))) AS down, min(dd) AS mdd, sum(greatest(r, 0)) AS gain, sum(greatest(-r, 0)) AS loss, arg_max(e, date) AS final FROM q)
SELECT days, round(mean, 6) AS mean, round(mean / dev, 6) AS ratio, round(mean / dev * sqrt(252), 6) AS sharpe, round(mean / down * sqrt(252), 6) AS sortino, round(mdd, 6) AS max_drawdown, round((power(final, 252.0 / days) - 1) / -mdd, 6) AS calmar, round(gain / loss, 6) AS profit_factor, round(final, 6) AS final FROM s""")
def risk(spark, sf_dir):
    out = ev.risk(book(spark, sf_dir))
    return out.select("days", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("ud12_walk_forward", f"""WITH bars AS ({BARS}), c AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT count(*) AS n FROM c), f AS (SELECT unnest(generate_series(0, CAST(floor((n - 252 - 4 - 21) / 63) AS INT))) AS fold FROM n)
SELECT fold, CASE WHEN i < fold * 63 + 252 THEN 'train' ELSE 'val' END AS role, date FROM c JOIN f ON i >= fold * 63 AND i < fold * 63 + 277 WHERE i < fold * 63 + 252 OR i >= fold * 63 + 256""")
def walk_forward(spark, sf_dir):
    return ev.walk_forward(daily(spark, sf_dir).select("date").distinct(), 252, 21, 63, 4)


@query("ud21_leakage_audit", PREPARED + f""", j AS (SELECT entity, date, lag(volume) OVER {E} AS feature, volume AS raw FROM p), k AS (SELECT *, lag(raw) OVER {E} AS earlier FROM j)
SELECT entity, count(*) AS n, round(avg(CASE WHEN abs(feature - earlier) < 1e-9 THEN 1.0 ELSE 0 END), 6) AS matches FROM k WHERE earlier IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def leakage_audit(spark, sf_dir):
    from stratagrid.functions.windows import before

    d = daily(spark, sf_dir).withColumn("feature", before("volume")).withColumn("earlier", before("volume"))
    return d.where("earlier is not null").groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.abs(F.col("feature") - F.col("earlier")) < 1e-9, 1.0).otherwise(0.0)), 6).alias("matches")).where("n >= 10")


@query("md07_09_yearly_medians", PREPARED + f", y AS (SELECT entity, year(date) AS year, median(close) AS close, median(volume) AS volume, count(*) AS n FROM p GROUP BY 1, 2) SELECT entity, year, round(close, 6) AS close, volume, coalesce(close / lead(close) OVER (PARTITION BY entity ORDER BY year) > 1.5, false) AS jump FROM y WHERE n >= 5")
def yearly_medians(spark, sf_dir):
    from pyspark.sql.window import Window

    y = daily(spark, sf_dir).groupBy("entity", F.year("date").cast("long").alias("year")).agg(F.median("close").alias("close"), F.median("volume").alias("volume"), F.count("*").alias("n")).where("n >= 5")
    later = F.lead("close").over(Window.partitionBy("entity").orderBy("year"))
    return y.select("entity", "year", F.round("close", 6).alias("close"), "volume", F.coalesce(F.try_divide("close", later) > 1.5, F.lit(False)).alias("jump"))


