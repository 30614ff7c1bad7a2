"""Queries of the rolling kernels, over daily volumes and closes of each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.functions.rolling import rolled
from stratagrid.functions.windows import rounded
from stratagrid.operators import kernels as k
from stratagrid.operators.technical import prepared
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import PREPARED, SO_FAR, E, select, w


#: SQL of each column that can be stated over prepared bars alone.
STATED: dict[str, str] = {}


def put(name: str, build, sql: dict[str, str], extra=None, head=None, places: int | dict[str, int] = 6):
    """Registers a query of the columns in ``sql``, which ``build`` gives as expressions over prepared bars."""
    if not head:
        STATED.update(sql)
    text = select(sql, **({"head": head} if head else {}), source="q" if head else "p", places=places)

    @query(name, text)
    def run(spark, sf_dir):
        df = prepared(daily(spark, sf_dir))
        df = extra(df) if extra else df
        return rolled(df, build).select(rounded(*sql, places=places))

    return run


mean = lambda x, n: f"(CASE WHEN rn >= {n} THEN sum(coalesce({x}, 0)) OVER {w(n)} / {n} ELSE avg({x}) OVER {SO_FAR} END)"
dev = lambda x, n: f"(CASE WHEN rn >= 2 THEN stddev_pop(coalesce({x}, 0)) OVER {w(n)} END)"

put("wk01_rolling_mean", lambda: {"m10": k.rolling_mean("volume", 10)}, {"m10": mean("volume", 10)})
put("wk02_rolling_std", lambda: {"s10": k.rolling_std("dc", 10)}, {"s10": dev("dc", 10)})
put("wk03_rolling_min", lambda: {"low20": k.rolling_min("close", 20)}, {"low20": f"min(close) OVER {w(20)}"})
put("wk04_rolling_quantile", lambda: {"q80": k.rolling_quantile("close", 20, 0.8)}, {"q80": f"CASE WHEN rn >= 5 THEN quantile_cont(close, 0.8) OVER {w(20)} END"})
put("wk05_rolling_slope", lambda: {"slope": k.rolling_slope("close", 20)}, {"slope": f"CASE WHEN rn >= 20 THEN regr_slope(close, rn) OVER {w(20)} END"})
put("wk06_percentile_rank", lambda: {"pr": k.rolling_percentile_rank("close", 126)}, {"pr": f"CASE WHEN rn >= 63 THEN len(list_filter(list(close) OVER {w(126)}, lambda v: v < close)) / CAST(len(list(close) OVER {w(126)}) AS DOUBLE) END"})
put("wk08_skew_proxy", lambda: {"sp": k.skew_proxy("close", 20)}, {"sp": f"CASE WHEN count(close) OVER {w(20)} = 20 THEN (avg(close) OVER {w(20)} - quantile_cont(close, 0.5) OVER {w(20)}) / (stddev_samp(close) OVER {w(20)} + 1e-8) END"})
put("wk09_expanding_zscore", lambda: {"z": k.expanding_zscore("close")}, {"z": f"CASE WHEN count(close) OVER {SO_FAR} >= 20 THEN (close - avg(close) OVER {SO_FAR}) / greatest(stddev_pop(close) OVER {SO_FAR}, 1e-8) END"})
put("wk10_series_zscore", lambda: {"z": k.series_zscore("close")}, {"z": "CASE WHEN stddev_pop(close) OVER (PARTITION BY entity) < 1e-10 THEN 0 ELSE (close - avg(close) OVER (PARTITION BY entity)) / stddev_pop(close) OVER (PARTITION BY entity) END"})
put("wk11_acceleration", lambda: {"acc": k.acceleration("close", 5, 20)}, {"acc": f"{mean('close', 5)} - {mean('close', 20)}"})
put("wk12_rolling_zscore", lambda: {"z": k.rolling_zscore("close", 20)}, {"z": f"(close - {mean('close', 20)}) / greatest({dev('close', 20)}, 1e-8)"})


@query("wk07_sign_streak", select({"streak": "streak"}, "s", head=PREPARED + f""",
i AS (SELECT *, sum(CASE WHEN dc * lag1 > 0 THEN 0 ELSE 1 END) OVER {SO_FAR} AS island FROM (SELECT *, lag(dc) OVER {E} AS lag1 FROM p)),
s AS (SELECT *, row_number() OVER (PARTITION BY entity, island ORDER BY date) - 1 AS streak FROM i)"""))
def sign_streak(spark, sf_dir):
    return k.sign_streak(prepared(daily(spark, sf_dir)), "dc").select("entity", "date", F.round("streak", 6).alias("streak"))
