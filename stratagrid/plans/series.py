"""Queries of time-axis features, targets and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.windows import rounded
from stratagrid.operators import series as s
from stratagrid.operators.technical import prepared
from stratagrid.plans.bars import daily
from stratagrid.plans.kernels import put
from stratagrid.plans.registry import query
from stratagrid.plans.sql import PREPARED, SO_FAR, E, full, select, w
from stratagrid.session import table


def some(x: str, d: int, least: int, agg: str = "avg") -> str:
    return f"(CASE WHEN count({x}) OVER {w(d)} >= {least} THEN {agg}({x}) OVER {w(d)} END)"


def sql(columns: dict[str, str], ctes: str = "", source: str = "p", places: int = 6) -> str:
    return select(columns, source, places, PREPARED + ctes)


put("wo01_bias", s.bias, {f"bias_{p}": f"(close - {full('close', p)}) / {full('close', p)} * 100" for p in (5, 10, 20, 60)})
put("wo02_lags", lambda: s.lags(["volume"]), {f"volume_lag{k}": f"lag(volume, {k}) OVER {E}" for k in s.LAGS})
PAST = "(PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
put("wo07_shock", lambda: s.shock("volume"), {"shock": f"CASE WHEN count(volume) OVER {PAST} >= 5 THEN greatest(0, least(20, volume / quantile_cont(volume, 0.5) OVER {PAST})) ELSE 1 END"})
Z = f"greatest(-5, least(5, (dv - {some('dv', 20, 5)}) / ({some('dv', 20, 5, 'stddev_pop')} + 1e-8)))"
put("wo09_intensity", lambda: s.intensity("dv"), {"flow_z": f"CASE WHEN dv IS NOT NULL AND count(dv) OVER {w(20)} >= 5 THEN {Z} END", "flow_extreme": f"CASE WHEN dv IS NOT NULL AND count(dv) OVER {w(20)} >= 5 THEN CAST(abs({Z}) > 1.8 AS INT) END"})
put("wo10_persistence", lambda: s.persistence("dv"), {f"inflow_{d}": f"sum(CASE WHEN dv > 0 THEN 1 ELSE 0 END) OVER {w(d)}" for d in (5, 10, 20)})
ALL = "count({x}) OVER W = count(*) OVER W AND count({x}) OVER W >= 3 AND stddev_pop({x}) OVER W >= 1e-12"
zl = lambda x: f"(CASE WHEN {ALL.format(x=x)} THEN ({x} - avg({x}) OVER W) / stddev_pop({x}) OVER W ELSE 0 END)".replace("OVER W", f"OVER {w(5)}")
put("wo13_residual", lambda: {"res": s.residual("dv", "ret")}, {"res": "CASE WHEN count(CASE WHEN dv IS NOT NULL AND ret IS NOT NULL THEN 1 END) OVER (PARTITION BY entity) >= 10 THEN dv - (regr_slope(dv, ret) OVER (PARTITION BY entity) * ret + regr_intercept(dv, ret) OVER (PARTITION BY entity)) ELSE dv END"})
put("wo18_holders", lambda: s.holders("volume"), {"hn_z": f"-(volume - {some('volume', 8, 4)}) / ({some('volume', 8, 4, 'stddev_pop')} + 1e-8)", "yoy": f"(volume - lag(volume, 4) OVER {E}) / lag(volume, 4) OVER {E}", "sma_60": some("volume", 60, 20)})
put("wo15_variation", lambda: {"cv": s.variation("volume", 20, 10)}, {"cv": f"{some('volume', 20, 10, 'stddev_pop')} / abs({some('volume', 20, 10)})"})
put("wo14_momentum", lambda: s.momentum("ret"), {f"mom_{d}": some("ret", d, max(5, d // 4), "sum") for d in (5, 20, 60, 252)})
put("wo26_text_windows", lambda: s.text_windows("ret"), {f"{k}_{d}": some("ret", d, max(1, d // 3), f) for d in (3, 5, 10, 20) for k, f in (("mean", "avg"), ("std", "stddev_samp"))})
put("wo42_sequence_summary", lambda: s.sequence_summary("close"), {"seq_mean": full("close", 20), "seq_std": full("close", 20, "stddev_pop"), "seq_slope": f"CASE WHEN count(close) OVER {w(20)} = 20 THEN regr_slope(close, rn) OVER {w(20)} END"})
put("wo38_flat_target", s.flat_target, {"flat_return": f"(lead(close, 5) OVER {E} - close) / (close + 1e-8)", "label": f"CASE WHEN (lead(close, 5) OVER {E} - close) / (close + 1e-8) > 0.003 THEN 2 WHEN (lead(close, 5) OVER {E} - close) / (close + 1e-8) < -0.003 THEN 0 WHEN lead(close, 5) OVER {E} IS NOT NULL THEN 1 END"})
put("wo25_expanding_share", lambda: {"share": s.expanding_share("volume")}, {"share": f"volume / max(volume) OVER {SO_FAR}"}, places=9)
W20 = w(20)
ten = lambda x: f"CASE WHEN count(ret) OVER {W20} >= 10 THEN {x} END"
HIGHER_SQL = {
    "skew_20": ten(f"skewness(ret) OVER {W20}"), "kurt_20": ten(f"kurtosis(ret) OVER {W20}"), "rv_20": ten(f"sqrt(sum(ret * ret) OVER {W20})"), "drawdown_20": f"close / max(close) OVER {W20} - 1",
    "up_ratio_20": ten(f"avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END) OVER {W20}"), "amihud": "abs(ret) / (close * volume + 1)", "vwap_gap": "close * volume / amount - 1"}
put("wo27_higher_order", s.higher_order, HIGHER_SQL)


@query("wo11_divergence", sql({"divergence": f"CAST(sign({zl('ret')}) <> sign({zl('fs')}) AS INT)"}, f", q AS (SELECT *, {some('dv', 5, 1, 'sum')} AS fs FROM p)", "q"))
def divergence(spark, sf_dir):
    return s.divergence(prepared(daily(spark, sf_dir)), "dv", "ret").select(rounded("divergence"))


@query("wo17_runs", sql({"run": "run", "run_max20": f"max(run) OVER {w(20)}"}, f""", i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER {SO_FAR} AS isle FROM p),
q AS (SELECT *, sum(CAST(up AS INT)) OVER (PARTITION BY entity, isle ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM i)""", "q"))
def runs(spark, sf_dir):
    return s.runs(prepared(daily(spark, sf_dir)), F.col("up")).select(rounded("run", "run_max20"))


@query("wo21_event_time", sql({"days_since": f"coalesce(rn - max(CASE WHEN x <> 0 THEN rn END) OVER {SO_FAR}, -1)", "count_20": f"sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END) OVER {W20}", "intensity_20": f"sum(abs(x)) OVER {W20}", "last_direction": f"coalesce(last_value(CASE WHEN x <> 0 THEN sign(x) END IGNORE NULLS) OVER {SO_FAR}, 0)"}, ", q AS (SELECT *, CASE WHEN volume > 40 THEN dc ELSE 0 END AS x FROM (SELECT * EXCLUDE dc, coalesce(dc, 0) AS dc FROM p))", "q"))
def event_time(spark, sf_dir):
    df = prepared(daily(spark, sf_dir)).withColumn("x", F.when(F.col("volume") > 40, F.coalesce("dc", F.lit(0.0))).otherwise(0.0))
    return s.event_time(df, "x").select(rounded("days_since", "count_20", "intensity_20", "last_direction"))


@query("wo20_yields", sql({"days_since_yield": "date_diff('day', d, date)", "effective_yield": "y * exp(-ln(2) / 365 * date_diff('day', d, date))", "recent_yield": "CAST(coalesce(date_diff('day', d, date) <= 90, false) AS INT)"}, f""",
q AS (SELECT *, max(CASE WHEN y0 > 0 THEN date END) OVER {SO_FAR} AS d, last_value(CASE WHEN y0 > 0 THEN y0 END IGNORE NULLS) OVER {SO_FAR} AS y FROM (SELECT *, CASE WHEN volume > 45 THEN volume / 100 ELSE 0 END AS y0 FROM p))""", "q"))
def yields(spark, sf_dir):
    df = daily(spark, sf_dir).withColumn("y", F.when(F.col("volume") > 45, F.col("volume") / 100).otherwise(0.0))
    return s.yields(df, "y").withColumn("recent_yield", F.col("recent_yield").cast("int")).select(rounded("days_since_yield", "effective_yield", "recent_yield"))


@query("wo14_16_rotation", sql({"rrg_y": "y", "rrg_x": "x", "quadrant": "CASE WHEN x > 0 THEN 2 ELSE 0 END + CASE WHEN y > 0 THEN 1 ELSE 0 END"}, f""",
a AS (SELECT *, {some('ret', 252, 63, 'sum')} AS t FROM p), b AS (SELECT *, (t - avg(t) OVER (PARTITION BY date)) / (stddev_samp(t) OVER (PARTITION BY date) + 1e-8) AS y FROM a),
q AS (SELECT *, y - lag(y, 10) OVER {E} AS x FROM b)""", "q"))
def rotation(spark, sf_dir):
    return s.rotation(prepared(daily(spark, sf_dir)), "ret").select(rounded("rrg_y", "rrg_x", "quadrant"))


@query("wo28_outlier_clip", sql({"dv_clip": "CASE WHEN n >= 10 AND mad > 1e-12 AND dv IS NOT NULL THEN greatest(m - 5 * mad, least(m + 5 * mad, dv)) ELSE dv END"}, f""",
a AS (SELECT *, count(dv) OVER {w(252)} AS n, quantile_cont(dv, 0.5) OVER {w(252)} AS m, list_filter(list(dv) OVER {w(252)}, lambda v: v IS NOT NULL) AS l FROM p),
q AS (SELECT *, list_median(list_transform(l, lambda v: abs(v - m))) AS mad FROM a)""", "q"))
def outlier_clip(spark, sf_dir):
    return s.outlier_clip(prepared(daily(spark, sf_dir)), "dv").select(rounded("dv_clip"))


@query("wo29_robust_scale", sql({"close_rs": "CASE WHEN n >= 63 THEN greatest(-1e4, least(1e4, (c - m) / (1.4826 * list_median(list_transform(l, lambda v: abs(v - m))) + greatest(1e-3 * abs(m), 1e-6)))) END"}, f""",
a AS (SELECT *, {some('close', 252, 63)} AS mu, {some('close', 252, 63, 'stddev_samp')} AS sd FROM p), b AS (SELECT *, CASE WHEN mu IS NOT NULL AND sd IS NOT NULL THEN greatest(mu - 3 * sd, least(mu + 3 * sd, close)) ELSE close END AS c FROM a),
q AS (SELECT *, count(c) OVER {w(252)} AS n, quantile_cont(c, 0.5) OVER {w(252)} AS m, list(c) OVER {w(252)} AS l FROM b)""", "q"))
def robust_scale(spark, sf_dir):
    return s.robust_scale(daily(spark, sf_dir), "close").select(rounded("close_rs"))


DENSE = f""", g AS (SELECT e.entity, c.date FROM (SELECT entity, min(date) AS a FROM p GROUP BY 1) e JOIN (SELECT DISTINCT date FROM p) c ON c.date >= e.a),
d AS (SELECT g.entity, g.date, open, high, low, close, volume, amount FROM g LEFT JOIN bars USING (entity, date))"""


@query("wo30_gap_lengths", sql({"gap": "CASE WHEN close IS NULL THEN count(*) FILTER (close IS NULL) OVER (PARTITION BY entity, i) ELSE 0 END"}, DENSE + f", q AS (SELECT *, count(close) OVER {SO_FAR} AS i FROM d)", "q"))
def gap_lengths(spark, sf_dir):
    return s.gap_lengths(s.grid(daily(spark, sf_dir)), "close").select(rounded("gap"))


def fold_sql(n: int) -> str:
    """The local level after ``n`` values, the last of them ``x``."""
    out = f"lag(x, {n - 1}) OVER {E}" if n > 1 else "x"
    for i, gain in enumerate(s.GAINS[: n - 1], 1):
        out = f"({out} * (1 - {gain!r}::DOUBLE) + {gain!r}::DOUBLE * {f'lag(x, {n - 1 - i}) OVER {E}' if n - 1 - i else 'x'})"
    return out


def imputed_sql(source: str, x: str, name: str = "im") -> str:
    """CTEs that fill the gaps of column ``x`` of ``source`` into ``{name}`` (entity, date, filled, has_gap)."""
    levels = " ".join(f"WHEN {n} THEN {fold_sql(n)}" for n in range(1, 5))
    return f"""{name}v AS (SELECT entity, date, CASE row_number() OVER {E} {levels} ELSE {fold_sql(5)} END AS lev FROM (SELECT entity, date, {x} AS x FROM {source} WHERE {x} IS NOT NULL)),
{name}c AS (SELECT s.entity, s.date, s.{x} AS x, last_value(s.{x} IGNORE NULLS) OVER {SO_FAR} AS keep, last_value(lev IGNORE NULLS) OVER {SO_FAR} AS lev, count(s.{x}) OVER {SO_FAR} AS i FROM {source} s LEFT JOIN {name}v USING (entity, date)),
{name}g AS (SELECT *, count(*) FILTER (x IS NULL) OVER (PARTITION BY entity, i) AS gap FROM {name}c),
{name} AS (SELECT entity, date, x IS NULL AS has_gap, CASE WHEN x IS NOT NULL THEN x WHEN gap > 10 THEN NULL WHEN gap <= 2 OR i < 2 THEN keep ELSE lev END AS filled FROM {name}g)"""


@query("wo30_imputed", PREPARED + DENSE + ", " + imputed_sql("d", "close") + " SELECT entity, date, round(filled, 7) AS filled, has_gap FROM im")
def imputed(spark, sf_dir):
    return s.imputed(s.grid(daily(spark, sf_dir)), "close").withColumn("filled", F.round("filled", 7))


A5 = "(PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@query("wo37_targets", sql({"fwd_return": "f", "direction": "CASE WHEN f > 0.003 * sqrt(5) THEN 2 WHEN f < -0.003 * sqrt(5) THEN 0 WHEN f IS NOT NULL THEN 1 END", "fwd_vol": "v"}, DENSE + f""",
r AS (SELECT *, close / lag(close) OVER {E} - 1 AS r, lead(open, 1) OVER {E} AS o1, lead(open, 6) OVER {E} AS o6, last_value(close IGNORE NULLS) OVER {A5} AS carry FROM d),
q AS (SELECT *, CASE WHEN o1 IS NOT NULL AND carry IS NOT NULL THEN coalesce(o6, carry) / o1 - 1 END AS f, CASE WHEN count(r) OVER {A5} >= 3 THEN stddev_pop(r) OVER {A5} END AS v FROM r)""", "q"))
def targets(spark, sf_dir):
    return s.targets(s.grid(daily(spark, sf_dir))).select(rounded("fwd_return", "direction", "fwd_vol"))


@query("wo35_36_eligibility", PREPARED + DENSE + f""",
o AS (SELECT *, CAST(close IS NOT NULL AS INT) AS o FROM d), a AS (SELECT *, sum(o) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h, avg(amount) OVER {w(60)} AS amt, sum(o) OVER {SO_FAR} AS isle FROM o),
m AS (SELECT *, sum(1 - o) OVER (PARTITION BY entity, isle ORDER BY date ROWS UNBOUNDED PRECEDING) AS missing FROM a)
SELECT entity, date, coalesce(lag(o) OVER {E} = 1, false) AS decided, coalesce(h >= 50, false) AS has_history, coalesce(lag(amt) OVER {E} >= 5e3, false) AS liquid, max(CASE WHEN missing >= 60 THEN 1 ELSE 0 END) OVER {w(61)} <> 1 AS not_halted FROM m""")
def eligibility(spark, sf_dir):
    return s.eligibility(s.grid(daily(spark, sf_dir))).select("entity", "date", "decided", "has_history", "liquid", "not_halted")


@query("wo33_pf26_intraday", """WITH e AS (SELECT *, user_id AS entity, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS minute FROM events)
SELECT event_id, row_number() OVER o AS bar_of_day, minute, minute BETWEEN 571 AND 690 AS is_am, minute BETWEEN 781 AND 900 AS is_pm,
  round(nth_value(value, 2) OVER a / first_value(value) OVER a - 1, 6) AS opening_move,
  round(CASE WHEN max(value) OVER r = min(value) OVER r THEN 0.5 ELSE (value - min(value) OVER r) / (max(value) OVER r - min(value) OVER r) END, 6) AS range_position FROM e
WINDOW o AS (PARTITION BY entity, day ORDER BY ts, event_id), r AS (PARTITION BY entity, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY entity, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def intraday(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("entity", F.col("user_id"))
    return s.intraday(e).select("event_id", "bar_of_day", F.col("minute").cast("long").alias("minute"), "is_am", "is_pm", *((F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("opening_move", "range_position")))


@query("wo39_pledges", sql({"balance": "b", "balance_max20": f"max(b) OVER {W20}"}, f", a AS (SELECT *, sum(CASE WHEN up THEN volume ELSE -volume END) OVER {SO_FAR} AS c FROM p), q AS (SELECT *, c - least(0, min(c) OVER {SO_FAR}) AS b FROM a)", "q"))
def pledges(spark, sf_dir):
    return s.pledges(prepared(daily(spark, sf_dir)), "volume", F.when(F.col("up"), 1.0).otherwise(-1.0)).select(rounded("balance", "balance_max20"))


@query("d11_sequences", PREPARED + f"SELECT entity, date, round(list_sum(list_transform(l, lambda x: x * 1.0)), 6) AS total FROM (SELECT entity, date, list(close) OVER {w(10)} AS l FROM p) WHERE len(l) = 10")
def sequences(spark, sf_dir):
    df = s.sequences(daily(spark, sf_dir), ["close", "volume"], 10)
    return df.select("entity", "date", F.round(F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v[0]), 6).alias("total"))
