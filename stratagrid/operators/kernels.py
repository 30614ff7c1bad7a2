"""Rolling kernels with a prefix at the head: zero-filled sums over full windows, plain moments before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, before, col, last_rows, row_number, so_far


def rolling_mean(x: Column | str, w: int) -> Column:
    """Full window: sum with NULL as 0, over w; before that the mean of what is there."""
    return F.when(row_number() >= w, F.sum(F.coalesce(col(x), F.lit(0.0))).over(last_rows(w)) / w).otherwise(F.avg(col(x)).over(so_far()))


def rolling_std(x: Column | str, w: int) -> Column:
    """Population deviation with NULL as 0; NULL on an entity's first row."""
    return F.when(row_number() >= 2, F.stddev_pop(F.coalesce(col(x), F.lit(0.0))).over(last_rows(w)))


def rolling_min(x: Column | str, w: int) -> Column:
    return F.min(col(x)).over(last_rows(w))


def rolling_quantile(x: Column | str, w: int, q: float, least: int = 5) -> Column:
    """Interpolated quantile of up to w rows, from row ``least`` on."""
    return F.when(row_number() >= least, F.percentile(col(x), F.lit(q)).over(last_rows(w)))


def rolling_slope(x: Column | str, w: int) -> Column:
    """Least-squares slope over the last w rows, full windows only; needs ``numbered``."""
    return F.when(F.col("rn") >= w, F.regr_slope(col(x), F.col("rn")).over(last_rows(w)))


def rolling_percentile_rank(x: Column | str, w: int, least: int = 63) -> Column:
    """Share of the last w values (the row's own among them) that are strictly below the row's."""
    held = F.collect_list(col(x)).over(last_rows(w))
    return F.when(row_number() >= least, F.size(F.filter(held, lambda v: v < col(x))) / F.size(held).cast("double"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``rn``, the row's number within its entity; slopes regress on it."""
    return df.withColumn("rn", row_number().cast("double"))


def sign_streak(df: DataFrame, x: str, name: str = "streak") -> DataFrame:
    """How many neighbours in a row have had the same sign up to this row; 0 where a run starts."""
    same = F.coalesce((F.col(x) * before(x)) > 0, F.lit(False))
    island = F.sum(F.when(same, 0).otherwise(1)).over(so_far())
    run = Window.partitionBy(ENTITY, "_island").orderBy(DATE)
    return df.withColumn("_island", island).withColumn(name, F.row_number().over(run) - 1).drop("_island")


def skew_proxy(x: Column | str, w: int) -> Column:
    """(mean - median) / (sample deviation + 1e-8), full windows only."""
    v, frame = col(x), last_rows(w)
    return F.when(F.count(v).over(frame) == w, (F.avg(v).over(frame) - F.percentile(v, F.lit(0.5)).over(frame)) / (F.stddev_samp(v).over(frame) + 1e-8))


def expanding_zscore(x: Column | str, least: int = 20) -> Column:
    v = col(x)
    z = (v - F.avg(v).over(so_far())) / F.greatest(F.stddev_pop(v).over(so_far()), F.lit(1e-8))
    return F.when(F.count(v).over(so_far()) >= least, z)


def series_zscore(x: Column | str) -> Column:
    """z over the entity's whole series; 0 where the series does not move."""
    v, whole = col(x), Window.partitionBy(ENTITY)
    dev = F.stddev_pop(v).over(whole)
    return F.when(dev < 1e-10, F.lit(0.0)).otherwise((v - F.avg(v).over(whole)) / dev)


def acceleration(x: Column | str, fast: int, slow: int) -> Column:
    return rolling_mean(x, fast) - rolling_mean(x, slow)


def rolling_zscore(x: Column | str, w: int) -> Column:
    return (col(x) - rolling_mean(x, w)) / F.greatest(rolling_std(x, w), F.lit(1e-8))
