"""Upkeep of stores: interval tails, price repair, unit checks, mergeable statistics of dates, vintage policies, monthly accounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, per_entity

#: What a channel may declare, and what each policy takes beside immutable snapshots.
SOURCES = ("immutable_snapshot", "latest_revised")
POLICIES = ("headline_strict", "revision_safe", "allow_revised")
WAIVED = ("daily_qfq", "market_env")


def extended(intervals: DataFrame, events: DataFrame, value: str) -> DataFrame:
    """Intervals [in_date, out_date) with a batch of later changes (entity, date, value), one a day at most.

    Only changes after the start of an entity's last interval count. The first of them closes that
    interval if it is open; each begins an interval up to the next, but for a NULL value, which only ends one.
    """
    last = intervals.groupBy(ENTITY).agg(F.max("in_date").alias("_last"))
    fresh = events.join(last, ENTITY, "left").where(F.col("_last").isNull() | (F.col(DATE) > F.col("_last")))
    first = fresh.groupBy(ENTITY).agg(F.min(DATE).alias("_first"))
    ends = F.col("out_date").isNull() & (F.col("in_date") == F.max("in_date").over(Window.partitionBy(ENTITY)))
    held = intervals.join(first, ENTITY, "left").withColumn("out_date", F.when(ends, F.col("_first")).otherwise(F.col("out_date")))
    added = fresh.withColumn("out_date", F.lead(DATE).over(per_entity())).where(F.col(value).isNotNull())
    columns = (ENTITY, value, "in_date", "out_date")
    return held.select(*columns).unionByName(added.withColumnRenamed(DATE, "in_date").select(*columns))


def lifted(df: DataFrame, columns: list[str], floor: float = 0.01) -> DataFrame:
    """Columns of an entity that hold a negative value are raised to ``floor`` at least; NULL stays NULL."""
    w = Window.partitionBy(ENTITY)
    return df.withColumns({c: F.when(F.col(c).isNotNull() & (F.min(c).over(w) < 0), F.greatest(F.col(c), F.lit(floor))).otherwise(F.col(c)) for c in columns})


def out_of_band(df: DataFrame, flip: Column, units: float = 100.0, band: float = 100.0) -> DataFrame:
    """Per entity: rows whose implied price, after volumes with ``flip`` are in units, is not within the band around close."""
    implied = F.col("amount") / (F.col("volume") * F.when(flip, units).otherwise(1.0))
    sound = (F.col("volume") > 0) & (F.col("amount") > 0) & (F.col("close") > 0)
    far = (implied < F.col("close") / band) | (implied > F.col("close") * band)
    return df.groupBy(ENTITY).agg(F.count_if(sound & far).alias("outside"), F.count_if(sound).alias("checked"))


def date_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per date and feature: count, sum and sum of squares, which add up over chunks of entities."""
    long = rows.unpivot([DATE], columns, "feature", "value").where("value is not null and not isnan(value)")
    v = F.col("value").cast("double")
    return long.groupBy(DATE, "feature").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))


def added_up(parts: list[DataFrame]) -> DataFrame:
    """The sums of several chunks."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(DATE, "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def date_statistics(sums: DataFrame) -> DataFrame:
    """Mean and sample deviation (1 for a single value, 1e-8 at least) from the sums."""
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    std = F.when(F.col("n") >= 2, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(1.0)
    return sums.select(DATE, "feature", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(std, F.lit(1e-8)).alias("std"))


def admitted(policy: str, transforms: list[str], waived=WAIVED) -> Column:
    """Whether a declared channel (channel, source_vintage, transform, pit_alignment) may be used; what is undeclared or unknown may not."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy}")
    known = F.col("source_vintage").isin(*SOURCES) & F.col("transform").isin(*transforms)
    fixed = F.col("source_vintage") == "immutable_snapshot"
    if policy == "allow_revised":
        fixed = F.lit(True)
    elif policy == "headline_strict":
        fixed = fixed & ((F.col("pit_alignment") == "verified") | F.col("channel").isin(*waived))
    return F.coalesce(known & fixed, F.lit(False))


def account_part(monthly: DataFrame, columns: list[str], d: int = 20) -> DataFrame:
    """Market-wide monthly rows on every day up to the last, with z over the last d of them (0 until then).

    One row a month, so the window without a key is bounded by the calendar.
    """
    w = Window.orderBy(DATE).rowsBetween(1 - d, 0)
    z = lambda c: F.when(F.count(c).over(w) == d, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)))
    dated = monthly.withColumns({f"{c}_z": F.coalesce(z(c), F.lit(0.0)) for c in columns} | {"_next": F.lead(DATE).over(Window.orderBy(DATE))})
    days = F.sequence(F.col(DATE), F.coalesce(F.date_sub("_next", 1), F.col(DATE)))
    return dated.withColumn(DATE, F.explode(days)).drop("_next")
