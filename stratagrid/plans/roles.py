"""Stored features scanned by role."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratagrid.functions.windows import returns
from stratagrid.operators import technical as te
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import PREPARED, full
from stratagrid.session import shared_dir, table
from stratagrid.sources import roles as ro

#: By name: role and SQL of each stored feature; features without a role are written and never read.
MADE = {
    "open": ("withheld", "open"), "high": ("withheld", "high"), "low": ("withheld", "low"), "close": ("withheld", "close"),
    "volume": ("past_known", "volume"), "amount": ("past_known", "amount"), "ma_5": ("past_known", full("close", 5)), "ma_20": ("past_known", full("close", 20)),
    "pct_change": ("past_known", "ret"), "month": ("past_known", "month(date)"), "sentiment_mean": ("past_observed", "CASE WHEN entity % 4 = 0 THEN 0.5 END"),
    "flow_z": ("past_observed", "CASE WHEN dv > 0 THEN dv END"), "openness": ("past_known", "CASE WHEN volume > 40 THEN 1 END"), "my_close": ("past_observed", "close"),
    "sector_code": ("meta", "s_nationkey"), "close_lag1": (None, ""), "topic_entropy": (None, ""), "margin_balance": (None, ""),
}


def written(spark, sf_dir) -> str:
    b = te.prepared(daily(spark, sf_dir))
    b = b.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector_code")), "entity")
    made = b.withColumns(te.moving_averages((5, 20))).withColumns({
        "pct_change": returns("close"), "month": F.month("date"), "sentiment_mean": F.when(F.col("entity") % 4 == 0, 0.5), "flow_z": F.when(F.col("dv") > 0, F.col("dv")), "openness": F.when(F.col("volume") > 40, 1),
        "my_close": F.col("close"), "close_lag1": F.col("close"), "topic_entropy": F.lit(1.0), "margin_balance": F.lit(2.0),
    })
    path = f"{shared_dir(spark)}/roles-{uuid.uuid4().hex}"
    ro.save(made.select("entity", "date", *MADE), path, off=("margin",))
    return path


def counts_sql() -> str:
    held = [(n, r, e) for n, (r, e) in MADE.items() if r and r not in ("meta", "withheld")]
    return " UNION ALL ".join(f"SELECT '{n}' AS feature, '{r}' AS role, count({e}) AS n, count(DISTINCT {e}) AS kinds FROM q" for n, r, e in held)


@query("pf30_roles", PREPARED + f", q0 AS (SELECT p.*, {', '.join(f'{e} AS {n}' for n, (_, e) in MADE.items() if n in ('ma_5', 'ma_20'))} FROM p), q AS (SELECT * FROM q0 JOIN supplier ON s_suppkey = entity WHERE date >= DATE '1997-01-01') "
       + counts_sql().replace(full("close", 5), "ma_5").replace(full("close", 20), "ma_20"))
def roles(spark, sf_dir):
    """Values and distinct values of each feature a model is given, from one scan a role."""
    path = written(spark, sf_dir)
    out = None
    for role in ("past_known", "past_observed"):
        df = ro.scan(spark, path, role, start="1997-01-01")
        names = [c for c in df.columns if c not in ("entity", "date")]
        long = df.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "feature", "v")
        by = long.groupBy("feature").agg(F.count("v").alias("n"), F.count_distinct("v").alias("kinds")).select("feature", F.lit(role).alias("role"), "n", "kinds")
        out = by if out is None else out.unionByName(by)
    return out
