"""Units of volume by year: shares or lots of a hundred, told from amount / (volume * close).

In one unit this ratio is about 1, in the other about 100. An entity's years are walked from the newest back: the
newest year's median sets the unit, and a jump of SWITCH or more between the medians of two years
changes it. Years with few rows take the nearest year's unit. Rows far from their year's median are
strays of the other unit, or junk.

Years of an entity are few, so the walk is a window over a row a year; rows meet their year by one join.

Defined results: rows without positive, finite volume, amount and close have no unit and are neither flipped nor
junk; ties of the nearest year go to the earlier one; an entity without a year of enough rows takes one
unit from the median of all its rows, or none if that is between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY

#: Fixed values of the classification: the jump between years, how far strays and junk lie from the median, the two units,
#: the band in which the newest median says nothing, medians no unit explains, and the rows a year needs.
SWITCH, STRAY, STRAY_MOST = 15.0, 30.0, 500.0
SHARES, LOTS = 1, 100
UNSURE_FROM, UNSURE_TO = 40.0, 60.0
LEAST_MEDIAN, MOST_MEDIAN = 0.05, 25_000.0
ENOUGH = 5


def with_ratio(df: DataFrame) -> DataFrame:
    """Sound rows with ``year`` and ``ratio``."""
    sound = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) > 0) & (F.col(c).cast("double") < float("inf")) for c in ("volume", "amount", "close")]
    return df.where(sound[0] & sound[1] & sound[2]).withColumns({"year": F.year(DATE).cast("long"), "ratio": F.col("amount").cast("double") / F.col("volume") / F.col("close")})


def by_level(median: Column, unsure: Column) -> Column:
    return F.when(median < UNSURE_FROM, SHARES).when(median > UNSURE_TO, LOTS).otherwise(unsure)


def medians(rows: DataFrame, *by: str) -> DataFrame:
    """``by``, median ratio and n, from rows sorted in their groups: no map of a group's values."""
    own = Window.partitionBy(*by)
    placed = rows.select(*by, "ratio", F.row_number().over(own.orderBy("ratio")).alias("_r"), F.count(F.lit(1)).over(own).alias("n"))
    middle = placed.where((2 * F.col("_r")).between(F.col("n"), F.col("n") + 2))  # one row, or the two around the middle
    return middle.groupBy(*by).agg(F.avg("ratio").alias("median"), F.max("n").alias("n"))


def years(rows: DataFrame) -> DataFrame:
    """Per entity and year of ``rows`` (with year and ratio): median, n, unit, corrupt and unsure."""
    by = medians(rows, ENTITY, "year")
    walked = by.where(F.col("n") >= ENOUGH)
    back = Window.partitionBy(ENTITY).orderBy(F.desc("year"))
    jump = F.lag("median").over(back) / F.col("median")
    base = by_level(F.col("median"), F.lit(SHARES))
    mark = F.when(F.lag("median").over(back).isNull(), base).when(jump >= SWITCH, SHARES).when(jump <= 1.0 / SWITCH, LOTS)
    walked = walked.withColumns({"mark": mark, "newest": F.lag("median").over(back).isNull()})
    walked = walked.withColumn("unit", F.last("mark", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    known = walked.select(ENTITY, "year", "unit", ((F.col("median") < LEAST_MEDIAN) | (F.col("median") > MOST_MEDIAN)).alias("corrupt"), (F.col("newest") & F.col("median").between(UNSURE_FROM, UNSURE_TO)).alias("unsure"))
    # a year of few rows: the nearest walked one; an entity has a few dozen years at most
    every = known.groupBy(ENTITY).agg(F.array_sort(F.collect_list(F.struct("year", "unit"))).alias("_known"))
    away = F.array_min(F.transform("_known", lambda k: F.struct(F.abs(k["year"] - F.col("year")).alias("away"), k["year"].alias("year"), k["unit"].alias("unit"))))
    # all rows of an entity are asked only where it has no walked year
    whole = medians(rows.join(every.select(ENTITY), ENTITY, "left_anti"), ENTITY).select(ENTITY, F.col("median").alias("_whole"))
    out = by.join(known, [ENTITY, "year"], "left").join(every, ENTITY, "left").join(whole, ENTITY, "left").where(F.col(ENTITY).isNotNull())
    lone = F.col("_known").isNull()
    unit = F.when(lone, by_level(F.col("_whole"), F.lit(None))).otherwise(F.coalesce("unit", away["unit"]))
    unsure = F.when(lone, F.col("_whole").between(UNSURE_FROM, UNSURE_TO)).otherwise(F.coalesce("unsure", F.lit(False)))
    return out.select(ENTITY, "year", "median", "n", unit.alias("unit"), F.coalesce("corrupt", F.lit(False)).alias("corrupt"), unsure.alias("unsure"))


def classified(df: DataFrame) -> DataFrame:
    """``df`` with ``unit`` of the row's year, ``flip`` (volume is in lots, to be multiplied) and ``junk`` (no unit explains the row)."""
    rows = with_ratio(df)
    known = years(rows).select(F.col(ENTITY).alias("_e"), F.col("year").alias("_y"), F.col("median").alias("_m"), "unit", "corrupt")
    joined = df.withColumn("_year", F.year(DATE).cast("long")).join(known, (F.col(ENTITY) == F.col("_e")) & (F.col("_year") == F.col("_y")), "left")
    fine = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("double") < float("inf")), F.lit(False))
    sound = fine("volume") & fine("amount") & fine("close") & F.col("unit").isNotNull()
    away = F.try_divide(F.try_divide(F.try_divide(F.col("amount").cast("double"), F.col("volume")), F.col("close")), F.col("_m"))
    shares = F.col("unit") == SHARES
    flip = F.when(shares, away.between(STRAY, STRAY_MOST)).otherwise(away.between(1.0 / STRAY, STRAY))
    junk = F.when(shares, away > STRAY_MOST).otherwise(away > STRAY) | (away < 1.0 / STRAY_MOST)
    known_row = lambda c: F.coalesce(sound & c, F.lit(False))
    return joined.withColumns({"flip": known_row(~F.col("corrupt") & flip), "junk": known_row(F.col("corrupt") | junk), "unit": F.when(sound, F.col("unit"))}).drop("_year", "_e", "_y", "_m", "corrupt")


def migrated(df: DataFrame) -> DataFrame:
    """``df`` with volumes in shares; junk rows stay as they are."""
    return classified(df).withColumn("volume", F.when(F.col("flip"), F.col("volume") * LOTS).otherwise(F.col("volume"))).drop("unit")
