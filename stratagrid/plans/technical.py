"""Queries of the technical indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.rolling import rolled
from stratagrid.functions.windows import rounded
from stratagrid.operators import technical as t
from stratagrid.plans.bars import daily
from stratagrid.plans.kernels import STATED, put
from stratagrid.plans.registry import query
from stratagrid.plans.sql import PREPARED, SO_FAR, E, full, nz, select, w

OTHERS = set(STATED)  # columns of other modules
CS = nz("close")
SPAN = nz("high - low")
put("wt01_kbar", t.kbar, {
    "kmid": f"(close - open) / {nz('open')}", "klen": f"(high - low) / {nz('open')}", "kmid2": f"(close - open) / {SPAN}",
    "kup": f"(high - greatest(open, close)) / {nz('open')}", "kup2": f"(high - greatest(open, close)) / {SPAN}",
    "klow": f"(least(open, close) - low) / {nz('open')}", "klow2": f"(least(open, close) - low) / {SPAN}",
    "ksft": f"(2 * close - high - low) / {nz('open')}", "ksft2": f"(2 * close - high - low) / {SPAN}"})
put("wt02_price_ratios", t.price_ratios, {f"{x}0": f"{x} / {CS}" for x in ("open", "high", "low")})
put("wt03_moving_averages", t.moving_averages, {f"ma_{d}": f"{full('close', d)} / {CS}" for d in (5, 10, 20, 60, 120)})
MID, DEV = full("close", 20), full("close", 20, "stddev_samp")
put("wt07_bollinger", t.bollinger, {"boll_mid": f"{MID} / {CS}", "boll_upper": f"({MID} + 2 * {DEV}) / {CS}", "boll_lower": f"({MID} - 2 * {DEV}) / {CS}", "boll_pct": f"(close - ({MID} - 2 * {DEV})) / {nz(f'4 * {DEV}')}"})
put("wt08_atr", lambda: {"atr_14": t.atr()}, {"atr_14": f"{full('tr', 14)} / {CS}"})
put("wt09_roc", t.roc, {f"roc_{p}": f"(close - lag(close, {p}) OVER {E}) / lag(close, {p}) OVER {E} * 100" for p in (6, 12, 20)})
put("wt10_williams", t.williams, {f"wr_{p}": f"({full('high', p, 'max')} - close) / {nz(full('high', p, 'max') + ' - ' + full('low', p, 'min'))} * -100" for p in (10, 20)})
CCI = {f"cci_{p}": f"CASE WHEN count(tp) OVER {w(p)} = {p} THEN (tp - avg(tp) OVER {w(p)}) / (CASE WHEN md{p} = 0 THEN 1e-10 ELSE md{p} END) / 0.015 END" for p in (14, 20)}
TYPICAL = ", ".join(f"list(tp) OVER {w(p)} AS l{p}, avg(tp) OVER {w(p)} AS a{p}" for p in (14, 20))
AWAY = ", ".join(f"list_sum(list_transform(l{p}, lambda v: abs(v - a{p}))) / len(l{p}) AS md{p}" for p in (14, 20))
put("wt11_cci", t.cci, CCI, head=PREPARED + f""",
q0 AS (SELECT *, {TYPICAL} FROM p),
q AS (SELECT *, {AWAY} FROM q0)""")  # fmt: skip
put("wt12_volatility", t.volatility, {f"vol_{p}": f"{full('lr', p, 'stddev_samp')} * sqrt(252)" for p in (5, 20)})
VOLUMES = {
    "volume_ma5": full("volume", 5), "volume_ratio": f"volume / {nz(full('volume', 5), '1')}", "obv": f"sum(CASE WHEN up THEN volume ELSE -volume END) OVER {SO_FAR}", "vol_up_ratio_20": full("CAST(up AS DOUBLE)", 20),
    "amount_ma5": full("amount", 5), "amount_ratio": f"amount / {nz(full('amount', 5), '1')}"}
put("wt13_14_volumes", t.volumes, VOLUMES)


def both(x: str, y: str, d: int) -> str:
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {w(d)} = {d} THEN corr({x}, {y}) OVER {w(d)} END"


def share(cond: str, d: int) -> str:
    return f"(CASE WHEN count(*) OVER {w(d)} = {d} THEN avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) OVER {w(d)} END)"


def spanned(d: int) -> dict[str, dict[str, str]]:
    """SQL of the indicators of the last d rows, by family; ``extremes`` need the columns hi{d} and lo{d}."""
    high, low = full("high", d, "max"), full("low", d, "min")
    q = lambda p: f"(CASE WHEN count(close) OVER {w(d)} = {d} THEN quantile_cont(close, {p}) OVER {w(d)} END)"
    n = f"count(close) OVER {w(d)} = {d}"
    rise, fall, total = full("CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END", d, "sum"), full("CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END", d, "sum"), full("abs(dc)", d, "sum")
    place = lambda sign, x: f"(CASE WHEN count({x}) OVER {w(d)} = {d} THEN (list_min(list_transform(list_filter(list({{'v': {x}, 'r': rn}}) OVER {w(d)}, lambda s: s.v = {sign}), lambda s: s.r)) - (rn - {d} + 1)) / {d - 1} END)"
    top, bottom = place(f"hi{d}", "high"), place(f"lo{d}", "low")
    vr, vf, vt = full("CASE WHEN dv IS NOT NULL THEN greatest(dv, 0) END", d, "sum"), full("CASE WHEN dv IS NOT NULL THEN greatest(-dv, 0) END", d, "sum"), full("abs(dv)", d, "sum")
    return {
        "position": {
            f"max_{d}": f"{high} / {CS}", f"min_{d}": f"{low} / {CS}", f"qtlu_{d}": f"{q(0.8)} / {CS}", f"qtld_{d}": f"{q(0.2)} / {CS}",
            f"rank_{d}": f"CASE WHEN count(close) OVER {w(d)} = {d} THEN len(list_filter(list(close) OVER {w(d)}, lambda v: v < close)) / {d}.0 END", f"rsv_{d}": f"(close - {low}) / {nz(f'{high} - {low}')}"},
        "correlations": {f"corr_{d}": both("close", "lv", d), f"cord_{d}": both("ret", "lvr", d)},
        "trend": {
            f"beta_{d}": f"CASE WHEN {n} THEN regr_slope(close, rn) OVER {w(d)} / {CS} END",
            f"rsqr_{d}": f"CASE WHEN {n} THEN CASE WHEN min(close) OVER {w(d)} = max(close) OVER {w(d)} THEN 1 ELSE regr_r2(close, rn) OVER {w(d)} END END",
            f"resi_{d}": f"CASE WHEN {n} THEN (close - (regr_slope(close, rn) OVER {w(d)} * rn + regr_intercept(close, rn) OVER {w(d)})) / {CS} END"},
        "volume_trend": {f"vma_{d}": f"{full('volume', d)} / {nz('volume')}", f"vstd_{d}": f"{full('volume', d, 'stddev_pop')} / {nz('volume')}"},
        "counts": {
            f"cntp_{d}": share("dc > 0", d), f"cntn_{d}": share("dc < 0", d), f"cntd_{d}": f"{share('dc > 0', d)} - {share('dc < 0', d)}",
            f"sump_{d}": f"{rise} / {nz(total)}", f"sumn_{d}": f"{fall} / {nz(total)}", f"sumd_{d}": f"({rise} - {fall}) / {nz(total)}"},
        "extremes": {f"imax_{d}": top, f"imin_{d}": bottom, f"imxd_{d}": f"{top} - {bottom}"},
        "volume_shape": {f"wvma_{d}": f"{full('rv', d, 'stddev_samp')} / {nz(full('rv', d))}", f"vsump_{d}": f"{vr} / {nz(vt)}", f"vsumn_{d}": f"{vf} / {nz(vt)}", f"vsumd_{d}": f"({vr} - {vf}) / {nz(vt)}"},
    }


def reached(d: int) -> str:
    return f"max(high) OVER {w(d)} AS hi{d}, min(low) OVER {w(d)} AS lo{d}"


for d in (5, 20, 60):
    of = spanned(d)
    put(f"wt15_position_{d}", lambda d=d: t.position(d), of["position"])
    put(f"wt16_correlations_{d}", lambda d=d: t.correlations(d), of["correlations"]) if d > 5 else None
    put(f"wt17_trend_{d}", lambda d=d: t.trend(d), of["trend"])
    put(f"wt17_volume_trend_{d}", lambda d=d: t.trend(d), of["volume_trend"], places=9)
    put(f"wt18_counts_{d}", lambda d=d: t.counts(d), of["counts"])
    put(f"wt19_extremes_{d}", lambda d=d: t.extremes(d), of["extremes"], head=PREPARED + f", q AS (SELECT *, {reached(d)} FROM p)")
    put(f"wt20_volume_shape_{d}", lambda d=d: t.volume_shape(d), of["volume_shape"],
        places={f"{x}_{d}": 9 for x in ("vsump", "vsumn", "vsumd")})  # shares of whole numbers, which often end in a 5 at the 7th place

UP, DOWN = full("CASE WHEN dtp > 0 THEN tp * volume WHEN dtp IS NOT NULL THEN 0 END", 14, "sum"), full("CASE WHEN dtp < 0 THEN tp * volume WHEN dtp IS NOT NULL THEN 0 END", 14, "sum")
put("wt22_money_flow", lambda: {"mfi_14": t.money_flow()}, {"mfi_14": f"100 - 100 / (1 + {UP} / {nz(DOWN)})"})
RISE, FALL = full("CASE WHEN dc IS NOT NULL THEN greatest(dc, 0) END", 14, "sum"), full("CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0) END", 14, "sum")
put("wt23_cmo", lambda: {"cmo_14": t.cmo()}, {"cmo_14": f"100 * ({RISE} - {FALL}) / {nz(f'{RISE} + {FALL}')}"})

#: One recursive step per row carries every recursive average of an entity.
A = {"12": "(2.0 / 13)", "26": "(2.0 / 27)", "9": "(2.0 / 10)", "15": "(2.0 / 16)"}
step = lambda alpha, x, y: f"{alpha} * ({x}) + (1 - {alpha}) * ({y})"
EWM = PREPARED.replace("WITH bars", "WITH RECURSIVE bars", 1) + f""",
s AS (
  SELECT entity, date, rn, close, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS dea, close AS t1, close AS t2, close AS t3,
         CAST(NULL AS DOUBLE) AS g6, CAST(NULL AS DOUBLE) AS l6, CAST(NULL AS DOUBLE) AS t0 FROM p WHERE rn = 1
  UNION ALL
  SELECT p.entity, p.date, p.rn, p.close, {step(A["12"], "p.close", "e12")}, {step(A["26"], "p.close", "e26")},
         {step(A["9"], f"({step(A['12'], 'p.close', 'e12')}) - ({step(A['26'], 'p.close', 'e26')})", "dea")},
         {step(A["15"], "p.close", "t1")}, {step(A["15"], step(A["15"], "p.close", "t1"), "t2")},
         {step(A["15"], step(A["15"], step(A["15"], "p.close", "t1"), "t2"), "t3")},
         CASE WHEN s.g6 IS NULL THEN greatest(p.dc, 0) ELSE {step("(1.0 / 6)", "greatest(p.dc, 0)", "s.g6")} END,
         CASE WHEN s.l6 IS NULL THEN greatest(-p.dc, 0) ELSE {step("(1.0 / 6)", "greatest(-p.dc, 0)", "s.l6")} END, s.t3
  FROM s JOIN p ON p.entity = s.entity AND p.rn = s.rn + 1)
"""
put_ewm = {"ema_12": f"e12 / {CS}", "ema_26": f"e26 / {CS}", "macd_dif": f"(e12 - e26) / {CS}", "macd_dea": f"dea / {CS}", "macd_hist": f"2 * (e12 - e26 - dea) / {CS}", "rsi_6": f"100 - 100 / (1 + g6 / {nz('l6')})", "trix": "(t3 / t0 - 1) * 100"}


@query("wt04_05_24_recursive", select(put_ewm, "s", head=EWM))
def recursive_with_sql(spark, sf_dir):
    return t.recursive(daily(spark, sf_dir), tuple(put_ewm)).select(rounded(*put_ewm))


def lowest(d: int) -> str:
    return f"CASE WHEN rn >= {d} THEN (close - min(low) OVER {w(d)}) / {nz(f'(max(high) OVER {w(d)} - min(low) OVER {w(d)})')} * 100 END AS v{d}"


def from_first(alpha: str, new: str, old: str) -> str:
    """A recursive average that begins with its first value."""
    return f"CASE WHEN {old} IS NULL THEN {new} ELSE {step(alpha, new, old)} END"


def averages(d: int) -> str:
    return f"{from_first('(1.0::DOUBLE / %d)' % d, 'greatest(q.dc, 0)', f's.g{d}')} AS g{d}, {from_first('(1.0::DOUBLE / %d)' % d, 'greatest(-q.dc, 0)', f's.l{d}')} AS l{d}"


WIDE = nz("wide")
#: Averages of gains and losses, of the close's place in its range, and of directed moves, a row at a time.
MOVES = PREPARED.replace("WITH bars", "WITH RECURSIVE bars", 1) + f""",
u AS (SELECT *, high - lag(high) OVER {E} AS ups, lag(low) OVER {E} - low AS downs, {lowest(9)}, {lowest(14)} FROM p),
q AS MATERIALIZED (SELECT *, CASE WHEN ups > downs AND ups > 0 THEN ups ELSE 0 END AS plus, CASE WHEN downs > ups AND downs > 0 THEN downs ELSE 0 END AS minus FROM u),
s AS (
  SELECT entity, date, rn, CAST(NULL AS DOUBLE) AS g12, CAST(NULL AS DOUBLE) AS l12, CAST(NULL AS DOUBLE) AS g24, CAST(NULL AS DOUBLE) AS l24,
         v9 AS k9, v9 AS d9, v14 AS k14, v14 AS d14, CAST(plus AS DOUBLE) AS pl, CAST(minus AS DOUBLE) AS mi, tr AS wide, CAST(0 AS DOUBLE) AS adx FROM q WHERE rn = 1
  UNION ALL
  SELECT entity, date, rn, g12, l12, g24, l24, k9, {from_first("(1.0::DOUBLE / 3)", "k9", "od9")}, k14, {from_first("(1.0::DOUBLE / 3)", "k14", "od14")}, pl, mi, wide,
         {step("(1.0::DOUBLE / 14)", f"100 * abs(100 * pl / {nz('wide')} - 100 * mi / {nz('wide')}) / {nz(f'(100 * pl / {WIDE} + 100 * mi / {WIDE})')}", "oadx")}
  FROM (SELECT q.entity, q.date, q.rn, {averages(12)}, {averages(24)}, {from_first("(1.0::DOUBLE / 3)", "q.v9", "s.k9")} AS k9, s.d9 AS od9, {from_first("(1.0::DOUBLE / 3)", "q.v14", "s.k14")} AS k14, s.d14 AS od14,
          {step("(1.0::DOUBLE / 14)", "q.plus", "s.pl")} AS pl, {step("(1.0::DOUBLE / 14)", "q.minus", "s.mi")} AS mi, {step("(1.0::DOUBLE / 14)", "q.tr", "s.wide")} AS wide, s.adx AS oadx
        FROM s JOIN q ON q.entity = s.entity AND q.rn = s.rn + 1) n)
"""
put_moves = {f"rsi_{d}": f"100 - 100 / (1 + g{d} / {nz(f'l{d}')})" for d in (12, 24)} | {f"kdj_{c}_{d}": e.format(d=d) for d in (9, 14) for c, e in (("k", "k{d}"), ("d", "d{d}"), ("j", "3 * k{d} - 2 * d{d}"))}
put_moves |= {"pdi": f"100 * pl / {nz('wide')}", "mdi": f"100 * mi / {nz('wide')}", "adx": "adx", "adxr": f"(adx + lag(adx, 14) OVER {E}) / 2"}


@query("wt06_21_recursive", select(put_moves, "s", head=MOVES))
def recursive_rest(spark, sf_dir):
    rest = tuple(n for n in t.RECURSIVE if n not in put_ewm)
    return t.recursive(daily(spark, sf_dir), rest).select(rounded(*rest))


def together() -> dict:
    """The window indicators, which share one partitioning, over all spans."""
    out = t.kbar() | t.price_ratios() | t.moving_averages() | t.bollinger() | t.roc() | t.williams() | t.cci() | t.volatility() | t.volumes() | {"atr_14": t.atr(), "mfi_14": t.money_flow(), "cmo_14": t.cmo()}
    for d in t.SPANS:
        out |= t.position(d) | t.correlations(d) | t.trend(d) | t.counts(d) | t.extremes(d) | t.volume_shape(d)
    return out


ALL = {n: e for n, e in STATED.items() if n not in OTHERS} | CCI | VOLUMES  # two of these stand under other modules' names, too
for d in t.SPANS:
    for of in spanned(d).values():
        ALL |= of
#: Ratios of whole numbers, which often end in a 5 at the 7th place.
PLACES = {f"{x}_{d}": 9 for d in t.SPANS for x in ("vma", "vstd", "vsump", "vsumn", "vsumd")}
REACHED = PREPARED + f""",
q0 AS (SELECT *, {TYPICAL}, {", ".join(map(reached, t.SPANS))} FROM p),
q AS (SELECT *, {AWAY} FROM q0)"""


@query("technical_all", select(ALL, "q", places=PLACES, head=REACHED))
def everything(spark, sf_dir):
    """All window indicators in one pass over one partitioning; those that carry a state from row to row are ``t.recursive``."""
    return rolled(t.prepared(daily(spark, sf_dir)), together).select(rounded(*ALL, places=PLACES))
