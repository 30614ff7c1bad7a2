"""Rankings of groups, coverage, unbiased moments and keep-one rules.

All are grouped aggregates that combine before the shuffle, or windows over one key. A window here
partitions by entity or by date, never by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def industry_ranking(df: DataFrame, change: str = "ret", places: int = 6) -> DataFrame:
    """Per (date, sector): mean and deviation of the change, rising and falling names, the leader (smallest entity of ties), rank by mean."""
    led = F.max_by("entity", F.struct(F.col(change), -F.col("entity")))
    by = (
        df.where(F.col(change).isNotNull())
        .groupBy("date", "sector")
        .agg(
            F.round(F.avg(change), places).alias("change"),
            F.round(F.stddev_samp(change), places).alias("dev"),
            F.count("*").alias("names"),
            F.count_if(F.col(change) > 0).alias("up"),
            F.count_if(F.col(change) < 0).alias("down"),
            led.alias("leader"),
        )
    )
    return by.withColumn("place", F.rank().over(Window.partitionBy("date").orderBy(F.desc("change"))))


def hot(df: DataFrame, group: str, value: str, level: float = 0.9) -> DataFrame:
    """Groups whose average rank of ``value`` among those of the date, as a share, lies above ``level``."""
    day = Window.partitionBy("date")
    ties = F.count("*").over(Window.partitionBy("date", value))
    share = (F.rank().over(day.orderBy(value)) + (ties - 1) / 2.0) / F.count("*").over(day)
    return df.withColumn("share", share).where(F.col("share") > level).select("date", group, "share")


def coverage_by_year(traded: DataFrame, covered: DataFrame) -> DataFrame:
    """Per year: entity-days that traded, those of them that ``covered`` has, and the share."""
    mark = covered.select("entity", "date").distinct().withColumn("_c", F.lit(1))
    joined = traded.select("entity", "date").join(mark, ["entity", "date"], "left")
    by = joined.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("traded"), F.count("_c").alias("covered"))
    return by.withColumn("share", F.col("covered") / F.col("traded"))


def unbiased_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: number of values, and skewness and excess kurtosis without bias (null below 3 and 4 values)."""
    by = df.groupBy(key).agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("s") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("k") + 6))
    return by.select(key, "n", skew.alias("skew"), kurt.alias("kurt"))


def listed(df: DataFrame, status: DataFrame, delisted: str = "delisted") -> DataFrame:
    """``df`` with ``is_listed``: 0 from the entity's delisting on; without such a date always 1."""
    joined = df.join(status.select("entity", delisted), "entity", "left")
    return joined.withColumn("is_listed", F.when(F.col("date") >= F.col(delisted), 0).otherwise(1)).drop(delisted)


def count_before(df: DataFrame, flag: Column, d: int, name: str) -> DataFrame:
    """How many of the ``d`` rows before each one carry ``flag``."""
    before = Window.partitionBy("entity").orderBy("date").rowsBetween(-d, -1)
    return df.withColumn(name, F.coalesce(F.count_if(flag).over(before), F.lit(0)))


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """The row of each key with the largest ``order`` (or smallest), as a map-side aggregate."""
    others = [c for c in df.columns if c not in keys]
    best = (F.max_by if last else F.min_by)(F.struct(*others), order)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")
