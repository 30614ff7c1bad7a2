"""Queries that drive a stream over the event table to its end and compare with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratagrid.plans.bars import daily
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS
from stratagrid.session import shared_dir, table
from stratagrid.streaming import events as ev
from stratagrid.streaming.panel import Panel, fed


def drained(spark, sf_dir, build, mode: str):
    """The rows that a streaming query over ``events`` has written when all input is read.

    All files are one batch: which of them was written first is chance, and read one by one a later time
    slice would move the watermark past the rows of the others. Batches go to Parquet in the shared folder.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src, out = f"{folder}/in", f"{folder}/out"
    table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    rows = build(ev.read(spark, src, None))
    spark.createDataFrame([], rows.schema).write.parquet(f"{out}/batch=-1")

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(out)
    if mode == "complete":  # each batch holds the whole result
        found = found.where(F.col("batch") == found.agg(F.max("batch").alias("last")).scalar())
    return found.drop("batch")


def in_slices(spark, rows, slices: int, build) -> tuple:
    """The rows that a streaming query in append mode has written after ``slices`` batches, and each batch's progress.

    ``rows`` has events and the number of the ``slice`` they arrive with. Each slice is added to the source's
    folder and is one batch with data, whatever number of files it has; the checkpoint carries watermark and
    state on to the next.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src, out, seen = f"{folder}/in", f"{folder}/out", []
    rows.where("false").drop("slice").write.parquet(src)
    frame = build(ev.read(spark, src, None))
    spark.createDataFrame([], frame.schema).write.parquet(f"{out}/batch=-1")

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for k in range(slices):
        rows.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(src)
        q = frame.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        seen += [(k, p["numInputRows"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])) for p in q.recentProgress]
    return spark.read.parquet(out).drop("batch"), seen


SLICES = 4
#: About so many events, of all slices, belong to the users that share a state.
BUCKET_ROWS = 1 << 15
#: Events arrive with the slice of their week; one in 13 is four days late, one in 29 eleven days.
DELAY = "CASE WHEN event_id % 29 = 3 THEN 11 WHEN event_id % 13 = 5 THEN 4 ELSE 0 END"
ARRIVALS = f"""WITH a AS (SELECT *, least({SLICES - 1}, floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + {DELAY}) / 7.5)) AS slice FROM events),
m AS (SELECT slice + 1 AS slice, date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM a GROUP BY 1), k AS MATERIALIZED (SELECT a.slice, max(mark) AS mark FROM (SELECT DISTINCT slice FROM a) a LEFT JOIN m ON m.slice <= a.slice GROUP BY 1),
g AS MATERIALIZED (SELECT a.*, coalesce(ts <= mark, false) AS late FROM a JOIN k USING (slice)), e AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM a)"""


def arrivals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor((day + F.expr(DELAY)) / 7.5)))


@query("st06_closed_windows", ARRIVALS + """ SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM g WHERE NOT late
GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT mark FROM e)""")
def closed_windows(spark, sf_dir):
    return in_slices(spark, arrivals(spark, sf_dir), SLICES, lambda e: ev.closed_windows(e, late="1 day"))[0]


@query("st07_late_rows", ARRIVALS + " SELECT CAST(slice AS BIGINT) AS slice, count(*) AS n, count(*) FILTER (late) AS late FROM g GROUP BY 1")
def late_rows(spark, sf_dir):
    """Rows of each slice, and how many of them the query dropped as late, by its own count."""
    _, seen = in_slices(spark, arrivals(spark, sf_dir), SLICES, lambda e: ev.on_time(e, late="1 day"))
    rows = spark.createDataFrame(seen, "slice long, n long, late long")
    return rows.groupBy("slice").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


@query("st08_idle_spells", ARRIVALS + """, o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM g WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM o)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, r HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT mark FROM e)""")
def idle_spells(spark, sf_dir):
    rows = arrivals(spark, sf_dir)
    buckets = max(64, -(-rows.count() // BUCKET_ROWS))
    return in_slices(spark, rows, SLICES, lambda e: ev.idle_spells(e, late="1 day", buckets=buckets))[0]


@query("st01_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    return drained(spark, sf_dir, ev.tumbling, "complete")


@query("st02_sliding", "SELECT start, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1")
def sliding(spark, sf_dir):
    return drained(spark, sf_dir, ev.sliding, "complete")


@query("st03_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def sessions(spark, sf_dir):
    return drained(spark, sf_dir, ev.sessions, "complete")


@query("st04_running_balance", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def running_balance(spark, sf_dir):
    out = drained(spark, sf_dir, ev.running_balance, "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query("st05_distinct", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def distinct(spark, sf_dir):
    return drained(spark, sf_dir, ev.distinct, "append").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


FEATURES = {"volume": "volume", "width": "round(high - low, 4)"}
PIECES = " UNION ALL ".join(f"SELECT entity, date, '{k}' AS feature, CAST({v} AS DOUBLE) AS v FROM bars" for k, v in FEATURES.items())


@query("cx03_incremental_z", f"""WITH bars AS ({BARS}), v AS MATERIALIZED ({PIECES}),
d AS (SELECT date, feature, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 1) AS dev, sum(v) AS s, sum(v * v) AS q FROM v GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER u AS pn, sum(s) OVER u AS ps, sum(q) OVER u AS pq FROM d WINDOW u AS (PARTITION BY feature ORDER BY date ROWS UNBOUNDED PRECEDING)),
m AS (SELECT date, feature, CASE WHEN n < 5 THEN ps / pn ELSE mean END AS mean, greatest(CASE WHEN n < 5 THEN sqrt(greatest(pq / pn - ps / pn * ps / pn, 0)) ELSE dev END, 1e-8) AS dev FROM p)
SELECT entity, date, feature, round((v - mean) / dev, 4) AS z FROM v JOIN m USING (date, feature)""")
def incremental_z(spark, sf_dir):
    """Entities arrive in three micro-batches, a third of them first with wrong values that the third batch replaces, and that batch comes twice."""
    folder = f"{shared_dir(spark)}/panel-{uuid.uuid4().hex}"
    rows = daily(spark, sf_dir).select("entity", "date", *(F.expr(v).cast("double").alias(k) for k, v in FEATURES.items()))
    third = F.col("entity") % 3
    wrong = rows.where(third == 1).withColumns({"volume": F.col("volume") + 1000, "date": F.date_add("date", 3)})
    panel = Panel(f"{folder}/store", list(FEATURES))
    rows.where("false").write.parquet(f"{folder}/in")
    run = fed(spark, panel, spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/state")
    for part in (wrong.unionByName(rows.where(third == 0)), rows.where(third == 2), rows.where(third == 1)):
        part.write.mode("append").parquet(f"{folder}/in")
        run()
    panel.merge(rows.where(third == 1), panel.batches(spark)[-1])
    return panel.scored(spark).withColumn("z", F.round("z", 4))
