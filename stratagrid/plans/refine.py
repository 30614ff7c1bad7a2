"""Queries of refined feature groups and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.windows import rounded
from stratagrid.operators import refine as r
from stratagrid.operators import series
from stratagrid.plans import chains
from stratagrid.plans.aggregates import BOOK, BRANDED, book, branded
from stratagrid.plans.bars import daily
from stratagrid.plans.cross_section import HEAD, panel
from stratagrid.plans.kernels import dev, mean, put
from stratagrid.plans.registry import query
from stratagrid.plans.series import DENSE, HIGHER_SQL, imputed_sql
from stratagrid.plans.sql import BARS, PREPARED, SO_FAR, E, select, w
from stratagrid.plans.text import POSTS, posts
from stratagrid.session import table

put("wo03_temporal", lambda: r.temporal(["volume"], []), {f"volume_ma{d}": mean("volume", d) for d in (5, 10, 20)} | {"volume_std20": dev("volume", 20), "volume_accel": f"{mean('volume', 5)} - {mean('volume', 20)}", "volume_z20": f"(volume - {mean('volume', 20)}) / greatest({dev('volume', 20)}, 1e-8)"})
X = "tone"
TONE = PREPARED + ", q AS (SELECT *, (volume - 25) / 25 AS tone FROM p)"
put("wo04_sentiment", lambda: r.sentiment(X, "volume"), {
    "tone_fast": mean(X, 5), "tone_slow": mean(X, 20), "tone_mom": f"{mean(X, 5)} - {mean(X, 20)}", "tone_vol": dev(X, 20), "tone_z": f"(tone - {mean(X, 20)}) / greatest({dev(X, 20)}, 1e-8)", "tone_accel": f"{mean(X, 3)} - {mean(X, 10)}",
    "tone_surprise": f"tone - lag(tone) OVER {E}", "tone_weighted": "tone * ln(1 + volume)", "tone_attention": f"(volume - {mean('volume', 20)}) / greatest({dev('volume', 20)}, 1e-8)"}, extra=lambda df: df.withColumn("tone", (F.col("volume") - 25) / 25), head=TONE)


@query("wo05_fundamentals", select({"improving": f"CASE WHEN close > lag(close, 63) OVER {E} THEN 1 ELSE 0 END", "stability": f"1 - {dev('close', 63)} / (abs({mean('close', 63)}) + 1e-8)", "slope": f"CASE WHEN rn >= 63 THEN regr_slope(close, rn) OVER {w(63)} END", "surprise": f"close - {mean('close', 63)}", "quality_z": f"CASE WHEN count(close) OVER {SO_FAR} >= 20 THEN (close - avg(close) OVER {SO_FAR}) / greatest(stddev_pop(close) OVER {SO_FAR}, 1e-8) END"}, places=5))
def fundamentals(spark, sf_dir):
    return r.fundamentals(daily(spark, sf_dir), "close").select(rounded("improving", "stability", "slope", "surprise", "quality_z", places=5))


Z60 = "CASE WHEN count({c}) OVER w >= 20 THEN coalesce(({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0), 0) ELSE 0 END"


@query("wo06_ag08_environment", f"""WITH bars AS ({BARS}), m AS (SELECT date, sum(volume) AS volume, CAST(count(*) AS DOUBLE) AS names FROM bars GROUP BY 1), z AS (SELECT date, {Z60.format(c='volume')} AS volume_z, {Z60.format(c='names')} AS names_z FROM m WINDOW w AS (ORDER BY date ROWS 59 PRECEDING))
SELECT date, round(volume_z, 6) AS volume_z, round(names_z, 6) AS names_z, round((volume_z + names_z) / 2, 6) AS composite FROM z""")
def environment(spark, sf_dir):
    m = daily(spark, sf_dir).groupBy("date").agg(F.sum("volume").alias("volume"), F.count("*").cast("double").alias("names"))
    return r.environment(m, ["volume", "names"]).select("date", *(F.round(c, 6).alias(c) for c in ("volume_z", "names_z", "composite")))


put("wo12_flow_ratios", lambda: r.flow_ratios(["dv", "volume"], "dv", "close"), {"dv_ratio": "dv / (abs(coalesce(dv, 0)) + abs(volume))", "volume_ratio": "volume / (abs(coalesce(dv, 0)) + abs(volume))", "main_by_price": "dv / abs(close)"})
THREE = f"count(premium) OVER {w(6)} >= 3"
put("wo23_block_windows", lambda: r.block_windows("premium", "volume", "turnover"), {
    "premium_cv": f"CASE WHEN {THREE} THEN stddev_pop(premium) OVER {w(6)} / nullif(abs(avg(premium) OVER {w(6)}), 0) END", "premium_change": f"(premium - lag(premium) OVER {E}) / nullif(lag(premium) OVER {E}, 0)", "deep": "CAST(premium < -8 AS INT)", "amount_share": "greatest(0, least(1, volume / turnover))"},
    extra=lambda df: df.withColumns({"premium": F.col("volume") - 30, "turnover": F.col("volume") + 20}), head=PREPARED + ", q AS (SELECT *, volume - 30 AS premium, volume + 20 AS turnover FROM p)")


@query("wo19_ag32_lockups", "SELECT l_suppkey AS entity, round(sum(l_discount * exp(-ln(2) / 180 * date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)))), 6) AS pressure, min(date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)))::INT AS next_days, count(*) AS unlocks FROM lineitem WHERE l_shipdate >= DATE '2000-01-01' GROUP BY 1")
def lockups(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_discount").alias("ratio"))
    return r.lockups(e, "2000-01-01").withColumn("pressure", F.round("pressure", 6))


@query("wo24_board_momentum", BRANDED + """, d AS (SELECT board, date, sum(premium) AS change FROM b GROUP BY 1, 2)
SELECT board, date, """ + ", ".join(f"round(CASE WHEN count(change) OVER w{d} >= {max(5, d // 4)} THEN sum(change) OVER w{d} END, 6) AS mom_{d}" for d in (63, 126, 252)) + " FROM d WINDOW " + ", ".join(f"w{d} AS (PARTITION BY board ORDER BY date ROWS {d - 1} PRECEDING)" for d in (63, 126, 252)))  # fmt: skip
def board_momentum(spark, sf_dir):
    d = branded(spark, sf_dir).groupBy("board", "date").agg(F.sum("premium").alias("change"))
    return r.board_momentum(d, "board", "change").select("board", "date", *(F.round(f"mom_{k}", 6).alias(f"mom_{k}") for k in (63, 126, 252)))


@query("wo34_trailing_mean", select({"m": f"coalesce(avg(volume) OVER {w(60)}, 0)"}, "d", head=PREPARED + DENSE))
def trailing_mean(spark, sf_dir):
    return series.grid(daily(spark, sf_dir)).withColumn("m", r.trailing_mean("volume")).select(rounded("m"))


PAST = "(PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("wo40_age", select({"x_held": f"last_value(x IGNORE NULLS) OVER {PAST}", "x_age": f"date_diff('day', max(CASE WHEN x IS NOT NULL THEN date END) OVER {PAST}, date)"}, "q", head=PREPARED + ", q AS (SELECT *, CASE WHEN volume > 40 THEN volume END AS x FROM p)"))
def age(spark, sf_dir):
    return r.age(daily(spark, sf_dir).withColumn("x", F.when(F.col("volume") > 40, F.col("volume"))), "x").select(rounded("x_held", "x_age"))


@query("wo41_momentum_grid", select({"momentum": "avg(r) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"}, "q", head=PREPARED + DENSE + f", h AS (SELECT entity, date, last_value(close IGNORE NULLS) OVER {SO_FAR} AS h FROM d), q AS (SELECT *, coalesce(h / lag(h) OVER {E} - 1, 0) AS r FROM h)"))
def momentum_grid(spark, sf_dir):
    return r.with_momentum_grid(series.grid(daily(spark, sf_dir))).select(rounded("momentum"))


@query("jn18_concept_stats", BRANDED + """, s AS (SELECT board, count(DISTINCT entity) AS size FROM b GROUP BY 1), c AS (SELECT date, board, count(*) FILTER (premium >= 0.09) AS hits, max(CASE WHEN premium >= 0.09 THEN l_linenumber END) AS top FROM b GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, hits, top, round(hits / size, 6) AS hit_share FROM b JOIN c USING (date, board) JOIN s USING (board)""")
def concept_stats(spark, sf_dir):
    out = r.concept_stats(branded(spark, sf_dir), "board", F.col("premium") >= 0.09, "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "hits", "top", F.round("hit_share", 6).alias("hit_share"))


FEATS = ("score", "volume", "ret")
UNPIVOT = HEAD + ", l AS (" + " UNION ALL ".join(f"SELECT entity, date, fwd, '{f}' AS feature, {f} AS value FROM m WHERE fwd IS NOT NULL AND {f} IS NOT NULL" for f in FEATS) + """),
k AS (SELECT feature, date, value, rank() OVER (PARTITION BY feature, date ORDER BY value) + (count(*) OVER (PARTITION BY feature, date, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, date ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, date, fwd) - 1) / 2.0 AS b FROM l),
d AS (SELECT feature, date, count(*) AS n, CASE WHEN min(value) < max(value) AND min(b) < max(b) THEN corr(a, b) END AS ic FROM k GROUP BY 1, 2),
i AS (SELECT feature, count(*) AS days, avg(ic) AS mean, stddev_samp(ic) AS dev, avg(ic) / stddev_samp(ic) AS icir, avg(CASE WHEN round(ic, 12) > 0 THEN 1.0 ELSE 0 END) AS positive FROM d WHERE n >= 5 AND ic IS NOT NULL GROUP BY 1)"""


@query("cx17_feature_ic", UNPIVOT + " SELECT feature, days, round(mean, 6) AS mean, round(dev, 6) AS dev, round(icir, 6) AS icir, round(positive, 6) AS positive FROM i")
def feature_ic(spark, sf_dir):
    return r.feature_ic(panel(spark, sf_dir), list(FEATS), "fwd", 5).select("feature", "days", *(F.round(c, 6).alias(c) for c in ("mean", "dev", "icir", "positive")))


@query("ud16_tk06_selected", UNPIVOT + " SELECT feature FROM i ORDER BY abs(mean) DESC, feature LIMIT 2")
def selected(spark, sf_dir):
    return r.selected(r.feature_ic(panel(spark, sf_dir), list(FEATS), "fwd", 5), 2).select("feature")


@query("ud19_ridge", HEAD + """, r AS (SELECT sum(score * score) + 1 AS a, sum(score * volume) AS b, sum(volume * volume) + 1 AS d, sum(score * fwd) AS p, sum(volume * fwd) AS q FROM m WHERE score IS NOT NULL AND volume IS NOT NULL AND fwd IS NOT NULL)
SELECT 'score' AS feature, round((d * p - b * q) / (a * d - b * b), 9) AS weight FROM r UNION ALL SELECT 'volume', round((a * q - b * p) / (a * d - b * b), 9) FROM r""")
def ridge(spark, sf_dir):
    w_ = r.ridge(panel(spark, sf_dir), ["score", "volume"], "fwd")
    return spark.createDataFrame(sorted((f, round(v, 9)) for f, v in w_.items()), "feature string, weight double")


@query("md02_point_in_time_ratio", f"""WITH bars AS ({BARS}), f AS (SELECT l_suppkey AS entity, last_day(CAST(l_shipdate AS DATE)) AS date, sum(l_quantity) - 20 AS eps FROM lineitem GROUP BY 1, 2)
SELECT b.entity, b.date, round(CASE WHEN eps > 0 AND close / eps > 0 AND close / eps <= 10000 THEN close / eps END, 6) AS ratio FROM bars b ASOF LEFT JOIN f ON b.entity = f.entity AND b.date >= f.date""")
def point_in_time(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.last_day(F.col("l_shipdate").cast("date")).alias("date")).agg((F.sum("l_quantity") - 20).alias("eps"))
    return r.point_in_time_ratio(daily(spark, sf_dir).select("entity", "date", "close"), f, "eps").select("entity", "date", F.round("ratio", 6).alias("ratio"))


LAGGED = ", ".join(f"lag(r, {i}) OVER (ORDER BY date) AS l{i}" for i in range(1, 6))
WEIGHTED = " + ".join(f"(1 - {i} / 6.0) * greatest(0, coalesce(c{i}, 0))" for i in range(1, 6))


@query("ud08_effective_size", BOOK + f", g AS (SELECT r, {LAGGED} FROM r), c AS (SELECT count(r) AS n, " + ", ".join(f"corr(r, l{i}) AS c{i}" for i in range(1, 6)) + f" FROM g) SELECT n, round(n / (1 + 2 * ({WEIGHTED})), 6) AS effective FROM c")
def effective_size(spark, sf_dir):
    return r.effective_size(book(spark, sf_dir), "r").withColumn("effective", F.round("effective", 6))


@query("chain_text", POSTS + """, w AS (SELECT *, power(0.5, greatest(date_diff('day', date, (SELECT max(date) FROM posts WHERE length(text) >= 5)), 0) / 7.0) AS weight FROM posts WHERE length(text) >= 5)
SELECT entity, date, count(*) AS n, round(avg(score), 6) AS mean, round(sum(score * weight) / sum(weight), 6) AS decayed_mean FROM w GROUP BY 1, 2""")
def chain_text(spark, sf_dir):
    out = chains.text_daily().run(posts(spark, sf_dir).drop("score"))
    return out.select("entity", "date", "n", F.round("mean", 6).alias("mean"), F.round("decayed_mean", 6).alias("decayed_mean"))


#: Changes of volume with gaps of 1, 4 and 12 rows, so that all rules of filling are met.
HOLES = "CASE WHEN rn % 40 = 5 OR rn % 40 BETWEEN 10 AND 21 OR rn % 40 BETWEEN 30 AND 33 THEN NULL ELSE dv END"
CHAIN = HEAD + f""", h AS (SELECT *, {HOLES} AS x FROM m), ha AS (SELECT *, count(x) OVER {w(252)} AS n, quantile_cont(x, 0.5) OVER {w(252)} AS md, list_filter(list(x) OVER {w(252)}, lambda v: v IS NOT NULL) AS l FROM h),
hm AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - md))) AS mad FROM ha),
hc AS MATERIALIZED (SELECT * EXCLUDE (l), CASE WHEN n >= 10 AND mad > 1e-12 AND x IS NOT NULL THEN greatest(md - 5 * mad, least(md + 5 * mad, x)) ELSE x END AS clipped FROM hm), {imputed_sql("hc", "clipped")},
hn AS (SELECT hc.* EXCLUDE (n), has_gap, CASE WHEN count(filled) OVER (PARTITION BY date, sector) >= 2 THEN filled - median(filled) OVER (PARTITION BY date, sector) ELSE filled END AS nt FROM hc JOIN im USING (entity, date)),
hd AS (SELECT *, stddev_samp(nt) OVER {w(20)} AS fast, stddev_samp(nt) OVER {w(60)} AS slow FROM hn),
hx AS MATERIALIZED (SELECT * EXCLUDE (fast, slow), nt * (1 + 0.5 * coalesce(CASE WHEN slow <> 0 AND fast IS NOT NULL THEN greatest(-0.5, least(1, (fast - slow) / slow)) END, 0)) AS neutral FROM hd)"""


def holed(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("x", F.expr(HOLES))


@query("cx09_chain_numeric", CHAIN + " SELECT entity, date, has_gap, round(neutral, 6) AS neutral FROM hx")
def chain_numeric(spark, sf_dir):
    df = holed(spark, sf_dir).select("entity", "date", "sector", "x")
    return chains.numeric("x").run(df).select("entity", "date", "has_gap", F.round("neutral", 6).alias("neutral"))


HIGHER = ["skew_20", "kurt_20", "rv_20", "drawdown_20", "up_ratio_20", "amihud", "vwap_gap"]


@query("chain_numeric_full", CHAIN + f""", ra AS (SELECT *, CASE WHEN count(neutral) OVER {w(252)} >= 63 THEN avg(neutral) OVER {w(252)} END AS mu, CASE WHEN count(neutral) OVER {w(252)} >= 63 THEN stddev_samp(neutral) OVER {w(252)} END AS sd FROM hx),
rb AS (SELECT *, CASE WHEN neutral IS NULL THEN NULL WHEN mu IS NOT NULL AND sd IS NOT NULL THEN greatest(mu - 3 * sd, least(mu + 3 * sd, neutral)) ELSE neutral END AS c FROM ra),
rq AS (SELECT *, count(c) OVER {w(252)} AS n, quantile_cont(c, 0.5) OVER {w(252)} AS rm, list_filter(list(c) OVER {w(252)}, lambda v: v IS NOT NULL) AS l FROM rb)
SELECT entity, date, round(CASE WHEN n >= 63 AND c IS NOT NULL THEN greatest(-1e4, least(1e4, (c - rm) / (1.4826 * list_median(list_transform(l, lambda v: abs(v - rm))) + greatest(1e-3 * abs(rm), 1e-6)))) END, 5) AS neutral_rs, """ + ", ".join(f"round({HIGHER_SQL[c]}, 5) AS {c}" for c in HIGHER) + " FROM rq")
def chain_numeric_full(spark, sf_dir):
    df = holed(spark, sf_dir).select("entity", "date", "sector", "x", "ret", "close", "volume", "amount")
    return chains.numeric_full("x").run(df).select("entity", "date", *(F.round(c, 5).alias(c) for c in ["neutral_rs", *HIGHER]))


@query("chain_concept", BRANDED + ", v AS (SELECT board, row_number() OVER (ORDER BY count(*) DESC, board) - 1 AS j FROM b WHERE date < DATE '1998-01-01' GROUP BY board HAVING count(*) >= 5) SELECT date, entity, " + ", ".join(f"max(CASE WHEN j = {j} THEN 1 ELSE 0 END) AS cb_{j}" for j in range(4)) + " FROM b LEFT JOIN v USING (board) GROUP BY 1, 2")
def chain_concept(spark, sf_dir):
    b = branded(spark, sf_dir)
    return chains.concept("board", 4).run(b, b.where("date < date '1998-01-01'"))


