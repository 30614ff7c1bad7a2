"""Event streams: the batch operators' incremental forms, with watermarks for late rows.

Each function takes a streaming (or batch) DataFrame with ``ts`` and returns one; the caller starts the
query with its own sink and a checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files: int | None = 1) -> DataFrame:
    """Parquet files of events as they appear in a folder, so many a batch; ``None``: all that are there.

    Files come in order of their modification time, so rows of a file that was written late may be behind
    the watermark if files are read one by one.
    """
    reader = spark.readStream.schema(SCHEMA)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
        .select(F.col("w.start").alias("start"), "n", "mean")
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause of ``gap``."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select("user_id", F.col("w.start").alias("start"), "n", "total")
    )


def distinct(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_balance(events: DataFrame) -> DataFrame:
    """Per user and batch: events and value so far, kept as state."""

    def step(key: tuple, batches, state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def on_time(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, without rows whose time isn't after the watermark of the batches before.

    Spark counts the rows it drops here one by one (``numRowsDroppedByWatermark`` of the batch's progress);
    the windows behind count groups only.
    """
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def closed_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """For append mode: counts and sums by event type of the windows that no further row can reach."""
    return (
        on_time(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    )


def idle_spells(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", buckets: int = 256) -> DataFrame:
    """For append mode: user_id, start, last, n and total of a user's runs of events, given out once the user was idle for ``gap``.

    Runs are state until a timer on event time says that the watermark has passed them; rows out of order
    may still join two of them until then. A user's state holds the runs within the watermark's delay
    and the gap only. Users are dealt by hash to ``buckets`` groups, each with one state and timer, so that a
    group's rows are worked on together; the number is part of the checkpoint and should grow with the users.
    """
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(key: tuple, batches, state: GroupState):
        held = [np.frombuffer(state.get[0], RUNS)] if state.exists else []
        for pdf in batches:
            own = np.empty(len(pdf), RUNS)
            # whole microseconds, as Arrow's unit is a session's own
            for c, v in (("nobody", "nobody"), ("user_id", "user_id"), ("start", "us"), ("last", "us"), ("total", "value")):
                own[c] = pdf[v].to_numpy()
            own["n"] = 1
            held.append(own)
        runs = merged(np.concatenate(held), wait * 1000)
        mark = state.getCurrentWatermarkMs() * 1000
        over = runs["last"] + wait * 1000 <= mark
        done, left = runs[over], runs[~over]
        if len(left):
            state.update((left.tobytes(),))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, -(-int(left["last"].min()) // 1000) + wait))
        elif state.exists:
            state.remove()
        if len(done):
            yield pd.DataFrame({c: done[c] for c in RUNS.names})

    nobody = F.col("user_id").isNull()
    rows = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"), nobody.alias("nobody"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("us"), "value"
    )
    out = rows.groupBy("bucket").applyInPandasWithState(step, "nobody boolean, user_id long, start long, last long, n long, total double", "runs binary", "append", GroupStateTimeout.EventTimeTimeout)
    user = F.when(~F.col("nobody"), F.col("user_id"))
    return out.select(user.alias("user_id"), F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n", F.round("total", 4).alias("total"))


RUNS = np.dtype([("nobody", "?"), ("user_id", "<i8"), ("start", "<i8"), ("last", "<i8"), ("n", "<i8"), ("total", "<f8")])


def merged(runs: np.ndarray, wait: int) -> np.ndarray:
    """Runs of any order and overlap, by user and start, those of one user joined that have less than ``wait`` between them."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs["total"], runs["last"], runs["start"], runs["user_id"], runs["nobody"]))]
    other = np.append(True, (runs["user_id"][1:] != runs["user_id"][:-1]) | (runs["nobody"][1:] != runs["nobody"][:-1]))
    upto = pd.Series(runs["last"]).groupby(np.cumsum(other)).cummax().to_numpy()
    at = np.flatnonzero(other | np.append(True, runs["start"][1:] - upto[:-1] >= wait))
    out = runs[at]
    out["last"] = upto[np.append(at[1:], len(runs)) - 1]
    out["n"], out["total"] = np.add.reduceat(runs["n"], at), np.add.reduceat(runs["total"], at)
    return out


def upsert(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the last row of each (entity, date) of a batch goes to ``write`` once; a batch that comes again writes the same rows."""

    def run(batch: DataFrame, number: int) -> None:
        from stratagrid.operators.channels import keep_last

        write(keep_last(batch, ["entity", "date"], "ts"), number)

    return run
