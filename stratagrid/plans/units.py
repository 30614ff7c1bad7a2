"""Units of volume over bars whose volumes were put into lots, strays and junk on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import units as u
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS
from stratagrid.session import stored

#: Early years of one entity in three are in lots; some rows are of the other unit or a thousand times off; one entity has a year nothing explains.
TAINT = """CASE WHEN entity % 13 = 4 AND year(date) = 1999 THEN 1e6 WHEN (entity + dayofyear(date)) % 97 = 0 THEN 1e4
  WHEN entity % 3 = 0 AND year(date) <= 1997 THEN CASE WHEN (entity * 7 + dayofyear(date)) % 41 = 0 THEN 1.0 ELSE 100.0 END
  WHEN (entity * 5 + dayofyear(date)) % 53 = 0 THEN 100.0 ELSE 1.0 END"""
#: One entity in nine has volumes in a few rows a year only.
SPARSE = "entity % 9 <> 2 OR (year(date) % 2 = 0 AND dayofyear(date) % 60 = 7) OR (entity % 2 = 0 AND year(date) = 1998)"
SQL = f"""WITH bars AS ({BARS}), b AS MATERIALIZED (SELECT entity, date, year(date) AS year, close, amount, CASE WHEN {SPARSE} THEN volume / {TAINT} END AS volume FROM bars),
r AS MATERIALIZED (SELECT *, amount / volume / close AS ratio FROM b WHERE volume IS NOT NULL),
y AS MATERIALIZED (SELECT entity, year, median(ratio) AS med, count(*) AS n FROM r GROUP BY 1, 2),
w AS (SELECT *, lag(med) OVER k AS newer FROM y WHERE n >= 5 WINDOW k AS (PARTITION BY entity ORDER BY year DESC)),
m AS (SELECT *, CASE WHEN newer IS NULL THEN CASE WHEN med > 60 THEN 100 ELSE 1 END WHEN newer / med >= 15 THEN 1 WHEN newer / med <= 1 / 15.0::DOUBLE THEN 100 END AS mark FROM w),
k AS MATERIALIZED (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY entity ORDER BY year DESC ROWS UNBOUNDED PRECEDING) AS unit FROM m),
a AS (SELECT entity, median(ratio) AS med FROM r GROUP BY 1),
u AS MATERIALIZED (SELECT y.entity, y.year, y.med AS median, y.n,
  CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.entity = y.entity) THEN CASE WHEN a.med < 40 THEN 1 WHEN a.med > 60 THEN 100 END
       ELSE (SELECT arg_min(k.unit, abs(k.year - y.year) * 10000 + k.year) FROM k WHERE k.entity = y.entity) END AS unit,
  y.n >= 5 AND (y.med < 0.05 OR y.med > 25000) AS corrupt,
  CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.entity = y.entity) THEN a.med BETWEEN 40 AND 60 ELSE coalesce((SELECT newer IS NULL AND k.med BETWEEN 40 AND 60 FROM k WHERE k.entity = y.entity AND k.year = y.year), false) END AS unsure
  FROM y JOIN a USING (entity))"""


def tainted(spark, sf_dir):
    volume = F.when(F.expr(SPARSE), F.col("volume") / F.expr(TAINT).cast("double"))
    # read for the medians and for the rows: bars are made once
    return stored(daily(spark, sf_dir).select("entity", "date", "close", "amount", volume.alias("volume")))


@query("md09_unit_years", SQL + " SELECT entity, year, round(median, 6) AS median, n, CAST(unit AS BIGINT) AS unit, corrupt, unsure FROM u")
def unit_years(spark, sf_dir):
    return u.years(u.with_ratio(tainted(spark, sf_dir))).withColumns({"median": F.round("median", 6), "unit": F.col("unit").cast("long")})


@query("md07_unit_rows", SQL + """, c AS (SELECT b.entity, b.date, volume, CASE WHEN volume IS NOT NULL THEN u.unit END AS unit, u.corrupt, amount / volume / close / u.median AS away FROM b LEFT JOIN u ON u.entity = b.entity AND u.year = b.year),
f AS (SELECT *, unit IS NOT NULL AND NOT corrupt AND CASE WHEN unit = 1 THEN away BETWEEN 30 AND 500 ELSE away BETWEEN 1 / 30.0::DOUBLE AND 30 END AS flip,
  unit IS NOT NULL AND (corrupt OR CASE WHEN unit = 1 THEN away > 500 ELSE away > 30 END OR away < 1 / 500.0::DOUBLE) AS junk FROM c)
SELECT entity, date, CAST(unit AS BIGINT) AS unit, flip, junk, round(volume * CASE WHEN flip THEN 100 ELSE 1 END, 6) AS volume FROM f""")
def unit_rows(spark, sf_dir):
    rows = u.classified(tainted(spark, sf_dir))
    return rows.select("entity", "date", F.col("unit").cast("long").alias("unit"), "flip", "junk", F.round(F.when(F.col("flip"), F.col("volume") * 100).otherwise(F.col("volume")), 6).alias("volume"))
