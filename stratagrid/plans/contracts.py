"""Queries of contracts and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.windows import before
from stratagrid.operators import contracts as c
from stratagrid.operators.technical import prepared
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS, PREPARED, E, full
from stratagrid.session import table

#: Codes in several spellings, from supplier keys.
CODES = """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'SH' || lpad((600000 + s_suppkey)::VARCHAR, 6, '0') WHEN 1 THEN lpad(s_suppkey::VARCHAR, 6, '0') || '.SZ' WHEN 2 THEN s_suppkey::VARCHAR WHEN 3 THEN (300000 + s_suppkey)::VARCHAR || '.0' ELSE 'SZ' || (600000 + s_suppkey)::VARCHAR END AS raw FROM supplier),
k AS (SELECT s_suppkey, raw, CASE s_suppkey % 5 WHEN 0 THEN (600000 + s_suppkey)::VARCHAR WHEN 3 THEN (300000 + s_suppkey)::VARCHAR WHEN 4 THEN NULL ELSE lpad(s_suppkey::VARCHAR, 6, '0') END AS code FROM s)"""


def codes(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("SH"), (k + 600000).cast("string"))).when(k % 5 == 1, F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".SZ"))).when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, F.concat((k + 300000).cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("SZ"), (k + 600000).cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).withColumn("code", c.normal_code("raw"))


@query("pf01_04_codes", CODES + " SELECT s_suppkey, raw, code, CASE WHEN code[1] = '6' THEN 'SH' WHEN code[1] IN ('0', '3') THEN 'SZ' END AS market, CASE WHEN left(code, 2) = '60' THEN 1 WHEN left(code, 2) = '00' THEN 3 WHEN left(code, 2) = '30' THEN 4 ELSE 0 END AS board, coalesce(regexp_matches(code, '^(60[0135]|00[0123]|30[012])'), false) AS equity FROM k")
def code_utilities(spark, sf_dir):
    return codes(spark, sf_dir).select("s_suppkey", "raw", "code", c.market("code").alias("market"), c.board("code").alias("board"), c.is_equity("code").alias("equity"))


CHANGED = f"WITH bars AS ({BARS}), b AS (SELECT *, CASE WHEN entity % 2 = 0 THEN round((close / lag(close) OVER {E} - 1) * 100, 2) ELSE 0 END AS pct_change, close / lag(close) OVER {E} AS q FROM bars)"


def changed(spark, sf_dir):
    own = F.round((F.try_divide(F.col("close"), before("close")) - 1) * 100, 2)
    return daily(spark, sf_dir).withColumn("pct_change", F.when(F.col("entity") % 2 == 0, own).otherwise(0.0))


RULES = {
    "null_key": "entity IS NULL OR date IS NULL", "weekend": "isodow(date) >= 6", "price_not_positive": "least(open, high, low, close) <= 0", "negative_volume": "volume < 0 OR amount < 0", "not_finite": "NOT coalesce(isfinite(close), false)",
    "below_low": "least(open, close) < low - 1e-9", "above_high": "greatest(open, close) > high + 1e-9", "pct_identity": "abs(pct_change - (q - 1) * 100) > 0.5", "amount_without_volume": "volume = 0 AND amount > 0", "volume_without_amount": "volume > 0 AND amount = 0", "vwap_out_of_band": "amount / volume < close / 100 OR amount / volume > close * 100",
}


@query("pf06_15_contract", CHANGED + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS violations FROM b" for k, v in RULES.items()))
def contract(spark, sf_dir):
    return c.report(changed(spark, sf_dir), c.bar_rules())


@query("pf07_repeated_keys", "WITH k AS (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT sum(n - 1)::BIGINT AS repeated, count(*) AS keys FROM k")
def repeated_keys(spark, sf_dir):
    return c.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate"])


@query("pf08_off_calendar", f"WITH bars AS ({BARS}) SELECT entity, date FROM bars WHERE isodow(date) >= 6")
def off_calendar(spark, sf_dir):
    d = daily(spark, sf_dir).select("entity", "date")
    return c.off_calendar(d, d.select("date").distinct().where(F.weekday("date") < 5))


@query("pf10_finite_share", PREPARED + " SELECT 'ret' AS feature, round(avg(CASE WHEN ret IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS share FROM p UNION ALL SELECT 'close', 1.0 FROM (SELECT 1)")
def finite_share(spark, sf_dir):
    return c.finite_share(prepared(daily(spark, sf_dir)), ["ret", "close"]).withColumn("share", F.round("share", 6))


@query("pf16_31_repaired_change", CHANGED + " SELECT entity, date, round(CASE WHEN pct_change IS NULL OR pct_change = 0 THEN (q - 1) * 100 ELSE pct_change END, 6) AS pct_change FROM b")
def repaired(spark, sf_dir):
    return c.repaired_change(changed(spark, sf_dir)).select("entity", "date", F.round("pct_change", 6).alias("pct_change"))


@query("pf17_18_alignment", f"WITH bars AS ({BARS}) SELECT entity, count(*) AS days, CASE WHEN entity % 3 = 0 THEN 0.5 ELSE 0 END AS worst, entity % 3 <> 0 AS ok FROM bars WHERE volume > 20 GROUP BY 1")
def alignment(spark, sf_dir):
    d = daily(spark, sf_dir)
    aux = d.where("volume > 20").withColumn("volume", F.col("volume") + F.when(F.col("entity") % 3 == 0, 0.5).otherwise(0.0))
    return c.alignment(aux, d, "volume", 1e-6)


@query("pf20_reconciled", f"WITH bars AS ({BARS}) SELECT entity, CASE WHEN w AND t THEN 'present' WHEN w THEN 'missing' ELSE 'unasked' END AS status FROM (SELECT coalesce(a.k, b.entity) AS entity, a.k IS NOT NULL AS w, b.entity IS NOT NULL AS t FROM (SELECT s_suppkey * 2 AS k FROM supplier) a FULL JOIN (SELECT DISTINCT entity FROM bars) b ON a.k = b.entity)")
def reconciled(spark, sf_dir):
    return c.reconciled(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("entity")), daily(spark, sf_dir))


@query("pf21_microstructure", PREPARED + f""" SELECT entity, date, coalesce(ret >= 0.098, false) AS limit_up, coalesce(ret <= -0.098, false) AS limit_down, coalesce(low > lag(high) OVER {E}, false) AS gap_up, coalesce(high < lag(low) OVER {E}, false) AS gap_down,
coalesce(open = high AND high = low AND low = close AND ret >= 0.098, false) AS one_word, round(CASE WHEN ret >= 0.098 THEN greatest(0, least(1, close / high)) ELSE 0 END, 6) AS seal FROM p""")
def microstructure(spark, sf_dir):
    m = c.microstructure()
    return daily(spark, sf_dir).select("entity", "date", *(F.coalesce(v, F.lit(False)).alias(k) if k != "seal" else F.round(v, 6).alias(k) for k, v in m.items()))


@query("pf22_23_classes", PREPARED + f""", k AS (SELECT entity, date, close AS c, {full('close', 5)} AS a, {full('close', 10)} AS b, {full('close', 20)} AS d, {full('close', 60)} AS e, volume / {full('volume', 5)} AS r FROM p)
SELECT entity, date, CASE WHEN c > a AND a > b AND b > d AND d > e THEN 6 WHEN c > a AND a > b AND b > d THEN 5 WHEN c > a AND a > b THEN 4 WHEN c < a AND a < b AND b < d AND d < e THEN 0 WHEN c < a AND a < b AND b < d THEN 1 WHEN c < a AND a < b THEN 2 ELSE 3 END AS trend,
CASE WHEN r < 0.7 THEN 'shrink' WHEN r > 1.5 THEN 'heavy' ELSE 'normal' END AS volume_class FROM k""")
def classes(spark, sf_dir):
    from stratagrid.functions import windows as w

    d = daily(spark, sf_dir).withColumns({f"m{k}": w.full("close", k) for k in (5, 10, 20, 60)} | {"r": F.try_divide(F.col("volume"), w.full("volume", 5))})
    return d.select("entity", "date", c.trend_class("close", "m5", "m10", "m20", "m60").alias("trend"), c.volume_class("r").alias("volume_class"))


@query("pf24_market_state", PREPARED + """, k AS (SELECT date, count(*) FILTER (ret >= 0.5) AS up, count(*) FILTER (ret <= -0.5) AS down, count(*) AS n FROM p GROUP BY 1)
SELECT date, CASE WHEN up > 0.4 * n THEN 'frenzy' WHEN down > 0.4 * n THEN 'ice' WHEN up > 0.2 * n AND down > 0.2 * n THEN 'volatile' WHEN up > 2 * down THEN 'strong' WHEN down > 2 * up THEN 'weak' ELSE 'normal' END AS state FROM k""")
def market_state(spark, sf_dir):
    k = prepared(daily(spark, sf_dir)).groupBy("date").agg(F.count_if(F.col("ret") >= 0.5).alias("up"), F.count_if(F.col("ret") <= -0.5).alias("down"), F.count("*").alias("n"))
    u, d, n = F.col("up"), F.col("down"), F.col("n")
    return k.select("date", F.when(u > 0.4 * n, "frenzy").when(d > 0.4 * n, "ice").when((u > 0.2 * n) & (d > 0.2 * n), "volatile").when(u > 2 * d, "strong").when(d > 2 * u, "weak").otherwise("normal").alias("state"))


@query("pf27_28_flat_share", PREPARED + ", f AS (SELECT entity, min(ret) = max(ret) AS a, min(entity % 2) = max(entity % 2) AS b FROM p GROUP BY 1) SELECT 'ret' AS feature, round(avg(coalesce(CAST(a AS DOUBLE), 1)), 6) AS share, avg(coalesce(CAST(a AS DOUBLE), 1)) >= 0.9 AS dead FROM f UNION ALL SELECT 'odd', round(avg(CAST(b AS DOUBLE)), 6), avg(CAST(b AS DOUBLE)) >= 0.9 FROM f")
def flat(spark, sf_dir):
    d = prepared(daily(spark, sf_dir)).withColumn("odd", (F.col("entity") % 2).cast("double"))
    return c.flat_share(d, ["ret", "odd"]).withColumn("share", F.round("share", 6))


@query("pf29_structural_quality", PREPARED + f", k AS (SELECT *, lead(close, 5) OVER {E} / close - 1 AS f FROM p) SELECT entity, CASE WHEN count(ret) = 0 THEN 'all missing' WHEN stddev_samp(ret) > 2.5 THEN 'too volatile' WHEN max(abs(f)) > 10 THEN 'outlier' END AS reason FROM k GROUP BY 1")
def structural(spark, sf_dir):
    return c.structural_quality(prepared(daily(spark, sf_dir)), "ret", 2.5)
