"""Walk-backward folds over the panel's sessions, their rows, gates and delistings, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import channels as ch
from stratagrid.operators import folds as fo
from stratagrid.plans.bars import daily
from stratagrid.plans.channels import SPELLS, membership
from stratagrid.plans.registry import query
from stratagrid.session import table

SHAPE = fo.Shape(seq=60, val=126, horizon=5, lockbox=252)
#: Two kinds of broken paths: one entity in seven has a stretch of closes in other units, one in eleven a single jump.
BROKEN = "CASE WHEN entity % 7 = 3 AND year(date) = 1997 AND month(date) = 3 THEN 300.0 WHEN entity % 11 = 5 AND date >= DATE '1998-02-01' AND date < DATE '1998-03-01' THEN 12.0 ELSE 1.0 END"
PLAN = SPELLS + f""",
c AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT count(*) AS n FROM c),
f0 AS (SELECT n, unnest(generate_series(0, (n - 5 - 126 - 252) // 126)) AS k FROM n WHERE n >= 383),
f1 AS (SELECT k + 1 AS fold, n, n - 383 - 126 * k AS val_start FROM f0), f2 AS (SELECT *, val_start - 60 AS train_end FROM f1 WHERE val_start - 60 >= 61),
f AS MATERIALIZED (SELECT fold, train_end - greatest(1, CAST(round_even(0.15::DOUBLE * (train_end - 60), 0) AS BIGINT)) - 60 AS inner_end, train_end, greatest(0, val_start - 60) AS test_from, val_start, val_start + 126 AS val_end, n AS sessions
  FROM f2 WHERE train_end - greatest(1, CAST(round_even(0.15::DOUBLE * (train_end - 60), 0) AS BIGINT)) - 60 >= 61)"""
SLICED = PLAN + """,
r AS (SELECT fold, sessions, 'inner_train' AS role, 0 AS a, 60 AS b, inner_end AS e FROM f UNION ALL SELECT fold, sessions, 'inner_val', inner_end, inner_end + 60, train_end FROM f UNION ALL SELECT fold, sessions, 'outer_test', test_from, val_start, val_end FROM f),
s2 AS MATERIALIZED (SELECT fold, role, c.date, c.i, c.i - a AS local, CASE WHEN c.i < b THEN 'context' WHEN c.i < e THEN 'target' ELSE 'pad' END AS part FROM r JOIN c ON c.i >= a AND c.i < least(e + 5, sessions))"""
JUDGED = SLICED + f""",
x AS (SELECT entity, i, close * {BROKEN} AS x FROM bars JOIN c USING (date)),
y AS MATERIALIZED (SELECT x.entity, x.i, (x.x - p.x) / (p.x + 1e-8) AS r, abs((x.x - q.x) / (q.x + 1e-8)) AS m FROM x LEFT JOIN x p ON p.entity = x.entity AND p.i = x.i - 1 LEFT JOIN x q ON q.entity = x.entity AND q.i = x.i - 5),
j AS MATERIALIZED (SELECT e.entity, f.fold, CASE WHEN count(y.i) = 0 THEN 'all_nan' WHEN stddev_pop(r) > 0.5 THEN 'hi_vol' WHEN max(m) > 10 THEN 'extreme_fwd' END AS reason
  FROM (SELECT DISTINCT entity FROM bars) e CROSS JOIN f LEFT JOIN y ON y.entity = e.entity AND y.i < f.train_end GROUP BY 1, 2)"""
STATUS = "SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 4 = 1 THEN DATE '1997-06-01' + CAST((s_suppkey * 37) % 1800 AS INT) END AS delisted FROM supplier"


def parts(spark, sf_dir):
    bars = daily(spark, sf_dir)
    sessions = fo.numbered(bars)
    return bars, sessions, fo.walk_backward(sessions, SHAPE)


def judged(bars, sessions, plan):
    return fo.quality(bars.withColumn("close", F.col("close") * F.expr(BROKEN)), sessions, plan)


def status(spark, sf_dir):
    key = F.col("s_suppkey")
    gone = F.date_add(F.lit("1997-06-01").cast("date"), ((key * 37) % 1800).cast("int"))
    return table(spark, sf_dir, "supplier").select(key.alias("entity"), F.when(key % 4 == 1, gone).alias("delisted"))


@query("ud13_walk_backward", PLAN + " SELECT fold, inner_end, train_end, test_from, val_start, val_end, sessions FROM f")
def walk_backward(spark, sf_dir):
    return parts(spark, sf_dir)[2].withColumn("fold", F.col("fold").cast("long"))


@query("ud13_fold_rows", JUDGED + """ SELECT fold, role, part, count(*) AS n, count(DISTINCT entity) AS entities, min(date) AS first, max(date) AS last, min(local) AS least, max(local) AS most
FROM s2 JOIN bars USING (date) JOIN j USING (entity, fold) WHERE reason IS NULL AND fold IN (SELECT fold FROM j GROUP BY fold HAVING count(*) FILTER (reason IS NULL) >= 5) GROUP BY 1, 2, 3""")
def fold_rows(spark, sf_dir):
    """Rows of each fold's slices, of the entities that are usable by their past in folds that have enough of them."""
    bars, sessions, plan = parts(spark, sf_dir)
    good = judged(bars, sessions, plan)
    folds = fo.usable(good, 5).select("fold")
    rows = bars.select("entity", "date").join(fo.sliced(sessions, plan, SHAPE), "date")
    rows = rows.join(good.where("reason is null").select("entity", "fold"), ["entity", "fold"], "left_semi").join(folds, "fold", "left_semi")
    by = rows.groupBy("fold", "role", "part").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), F.min("date").alias("first"), F.max("date").alias("last"), F.min("local").alias("least"), F.max("local").alias("most"))
    return by.withColumn("fold", F.col("fold").cast("long"))


@query("ud14_fold_quality", JUDGED + " SELECT entity, fold, reason FROM j")
def fold_quality(spark, sf_dir):
    return judged(*parts(spark, sf_dir)).withColumn("fold", F.col("fold").cast("long"))


@query("ud14_gate_reasons", JUDGED + f""", st AS ({STATUS}),
gt AS (SELECT s2.fold, role, CASE WHEN j.reason IS NOT NULL THEN 'unusable' WHEN b.date >= st.delisted THEN 'delisted' WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.entity = b.entity AND s.in_date <= b.date AND (s.out_date IS NULL OR b.date < s.out_date)) THEN 'no_member' WHEN NOT coalesce(b.volume >= 10, false) THEN 'undecided' END AS reason
  FROM bars b JOIN s2 ON s2.date = b.date AND part = 'target' AND role <> 'inner_train' JOIN j ON j.entity = b.entity AND j.fold = s2.fold LEFT JOIN st ON st.entity = b.entity)
SELECT fold, role, coalesce(reason, 'candidate') AS reason, count(*) AS n FROM gt GROUP BY ALL""")
def gate_reasons(spark, sf_dir):
    """Of the rows that validation and test would rank: how many the gates let through, and why others fall; training stays ungated."""
    bars, sessions, plan = parts(spark, sf_dir)
    rows = ch.member_flag(bars.select("entity", "date", "volume"), membership(spark, sf_dir)).join(status(spark, sf_dir), "entity", "left")
    rows = rows.join(fo.sliced(sessions, plan, SHAPE).where("part = 'target' and role <> 'inner_train'"), "date")
    rows = rows.join(judged(bars, sessions, plan).withColumnRenamed("reason", "fault"), ["entity", "fold"])
    gates = {"unusable": F.col("fault").isNull(), "delisted": F.col("delisted").isNull() | (F.col("date") < F.col("delisted")), "no_member": F.col("is_member"), "undecided": F.col("volume") >= 10}
    by = fo.gated(rows, gates).groupBy("fold", "role", F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("n"))
    return by.withColumn("fold", F.col("fold").cast("long"))


@query("ud14_delist_index", PLAN + f""", st AS ({STATUS}),
d AS (SELECT st.entity, (SELECT max(c.i) FROM c WHERE c.date <= st.delisted) AS i FROM st)
SELECT entity, fold, CASE WHEN i >= val_start AND i < least(val_end + 5, sessions) THEN i - val_start ELSE -1 END AS forced FROM d CROSS JOIN f""")
def delist_index(spark, sf_dir):
    _, sessions, plan = parts(spark, sf_dir)
    return fo.delist_index(status(spark, sf_dir), sessions, plan, SHAPE).withColumn("fold", F.col("fold").cast("long"))


@query("ud14_sliced", SLICED + " SELECT fold, role, date, i, local, part FROM s2")
def sliced(spark, sf_dir):
    _, sessions, plan = parts(spark, sf_dir)
    return fo.sliced(sessions, plan, SHAPE).select(F.col("fold").cast("long").alias("fold"), "role", "date", "i", "local", "part")
