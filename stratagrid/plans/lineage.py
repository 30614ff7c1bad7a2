"""Stale outputs after a change of the bars, and corrupted copies of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import corruption as co
from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS
from stratagrid.sources import lineage as li

#: What hangs on what: features of a year read the bars of it and of the year before, a panel two years of features, the report all panels.
DEPENDS = """years AS (SELECT DISTINCT year(date) AS y FROM bars),
e AS (SELECT 'features' AS output, CAST(y AS STRING) AS partition, 'bars' AS input, CAST(y AS STRING) AS input_partition FROM years
 UNION ALL SELECT 'features', CAST(y + 1 AS STRING), 'bars', CAST(y AS STRING) FROM years WHERE y + 1 IN (SELECT y FROM years)
 UNION ALL SELECT 'panel', CAST(y - y % 2 AS STRING), 'features', CAST(y AS STRING) FROM years
 UNION ALL SELECT DISTINCT 'report', 'all', 'panel', CAST(y - y % 2 AS STRING) FROM years
 UNION ALL SELECT 'sectors', CAST(y AS STRING), 'bars', CAST(y AS STRING) FROM years
 UNION ALL SELECT 'index', CAST(y AS STRING), 'bars', CAST(y AS STRING) FROM years)"""
#: The bars as they are now: one close of 1997 is another.
TOUCHED = "CASE WHEN date = (SELECT min(date) FROM bars WHERE date >= DATE '1997-05-01') AND entity = (SELECT max(entity) FROM bars WHERE date = (SELECT min(date) FROM bars WHERE date >= DATE '1997-05-01')) THEN close + 1 ELSE close END"
KINDS = ("features", "panel", "report", "sectors", "index")


@query("ud23_stale_outputs", f"""WITH RECURSIVE bars AS ({BARS}), {DEPENDS.replace('STRING', 'VARCHAR')},
now AS (SELECT *, {TOUCHED} AS c FROM bars), diff AS (SELECT DISTINCT CAST(year(date) AS VARCHAR) AS p FROM now WHERE c <> close),
f AS (SELECT DISTINCT output, partition, 'source' AS reason FROM e WHERE input = 'bars' AND input_partition IN (SELECT p FROM diff) AND output <> 'index'
  UNION ALL SELECT DISTINCT output, partition, 'config' FROM e WHERE output = 'sectors' UNION ALL SELECT DISTINCT output, partition, 'missing' FROM e WHERE output = 'index'),
t AS (SELECT DISTINCT output, partition, 0 AS steps FROM f UNION SELECT e.output, e.partition, t.steps + 1 FROM t JOIN e ON e.input = t.output AND e.input_partition = t.partition),
s AS (SELECT output, partition, min(steps) AS steps FROM t GROUP BY 1, 2)
SELECT s.output, s.partition, s.steps, coalesce((SELECT string_agg(reason, ',' ORDER BY reason) FROM f WHERE f.output = s.output AND f.partition = s.partition), 'upstream') AS reasons FROM s""")
def stale_outputs(spark, sf_dir):
    """One close has changed, sectors have other settings, and the index was never recorded."""
    bars = daily(spark, sf_dir).select("entity", "date", "close", F.year("date").alias("year"))
    depends = spark.sql(f"WITH bars AS (SELECT * FROM {{bars}}), {DEPENDS} SELECT * FROM e", bars=bars)
    now = spark.sql(f"WITH bars AS (SELECT * FROM {{bars}}) SELECT entity, date, {TOUCHED} AS close, year FROM bars", bars=bars)
    was = {k: li.hash_of_settings({"kind": k, "horizon": 5}) for k in KINDS}
    code = dict.fromkeys(KINDS, li.hash_of_code(daily))
    held = li.record(depends, li.digests(bars, "year", "bars"), was, code).where("output <> 'index'")
    first = li.changed(held, depends, li.digests(now, "year", "bars"), was | {"sectors": li.hash_of_settings({"kind": "sectors", "horizon": 6})}, code)
    reasons = first.groupBy("output", "partition").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    out = li.stale(depends, first).join(reasons, ["output", "partition"], "left")
    return out.select("output", "partition", F.col("steps").cast("int").alias("steps"), F.coalesce("reasons", F.lit("upstream")).alias("reasons"))


COLUMNS = ["high", "low", "close", "volume"]
SEED = 20  # of those below 30, one whose time mask falls and that drops a column


def hashed(*what: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{SEED}', " + ", ".join(what) + f")), 1, 13))::BIGINT + 0.5::DOUBLE) / {16**13}.0::DOUBLE)"


def noisy(c: str) -> str:
    a, b = (hashed(f"'{x}'", f"'{c}'", "entity::VARCHAR", "date::VARCHAR") for x in "ab")
    value = f"CASE WHEN volume >= 20 THEN {c} + 0.5 * sqrt(-2 * ln({a})) * cos(2 * pi() * {b}) ELSE {c} END"
    return f"round(CASE WHEN date IN (SELECT date FROM hidden) OR {hashed(chr(39) + 'dropout' + chr(39), chr(39) + c + chr(39))} < 0.25 THEN 0 ELSE {value} END, 7) AS {c}"


@query("ud22_corrupted", f"""WITH bars AS ({BARS}), o AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT count(*) AS n FROM o),
r AS (SELECT n, 1 + floor({hashed("'length'")} * least(5, n // 2)) AS length FROM n), s AS (SELECT *, floor({hashed("'start'")} * (n - length)) AS start FROM r WHERE n >= 3 AND {hashed("'mask'")} < 0.5),
hidden AS MATERIALIZED (SELECT date FROM o, s WHERE i >= start AND i < start + length)
SELECT entity, date, """ + ", ".join(map(noisy, COLUMNS)) + " FROM bars")
def corrupted(spark, sf_dir):
    out = co.corrupted(daily(spark, sf_dir), COLUMNS, SEED, F.col("volume") >= 20, 0.5, 0.5, 0.25)
    return out.select("entity", "date", *(F.round(c, 7).alias(c) for c in COLUMNS))
