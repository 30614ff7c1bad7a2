"""Refined feature groups: temporal statistics, sentiment, fundamentals, market environment, flows, events and boards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, at_least, before, clip, correlation, last_rows, per_date, per_entity, so_far
from stratagrid.operators import kernels as k


def temporal(columns: list[str], flags: list[str] = ()) -> dict[str, Column]:
    """Means over 5, 10 and 20 rows, deviation, acceleration and z over 20; flags get the means only."""
    out = {}
    for c in [*columns, *flags]:
        out |= {f"{c}_ma{d}": k.rolling_mean(c, d) for d in (5, 10, 20)}
    for c in columns:
        out |= {f"{c}_std20": k.rolling_std(c, 20), f"{c}_accel": k.acceleration(c, 5, 20), f"{c}_z20": k.rolling_zscore(c, 20)}
    return out


def mostly_zero(df: DataFrame, columns: list[str], share: float = 0.8) -> list[str]:
    """Columns that are 0 on at least ``share`` of the rows (one aggregate over the whole table: a statistic of all dates)."""
    row = df.agg(*(F.avg(F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(0.0)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] >= share]


def sentiment(x: str, n: str) -> dict[str, Column]:
    """Level, momentum, surprise, volatility and volume-weighted tone of a sentiment source."""
    fast, slow = k.rolling_mean(x, 5), k.rolling_mean(x, 20)
    return {
        f"{x}_fast": fast, f"{x}_slow": slow, f"{x}_mom": fast - slow, f"{x}_vol": k.rolling_std(x, 20), f"{x}_z": k.rolling_zscore(x, 20), f"{x}_accel": k.acceleration(x, 3, 10),
        f"{x}_surprise": F.col(x) - before(x), f"{x}_weighted": F.col(x) * F.log1p(n), f"{x}_attention": k.rolling_zscore(n, 20),
    }


def fundamentals(df: DataFrame, x: str, quarter: int = 63) -> DataFrame:
    """Change against a quarter ago, stability, expanding z, valuation rank, slope, acceleration and surprise."""
    mean, dev = k.rolling_mean(x, quarter), k.rolling_std(x, quarter)
    return k.numbered(df).withColumns({
        "delta": F.col(x) - before(x, quarter), "improving": F.coalesce(F.col(x) > before(x, quarter), F.lit(False)).cast("int"), "quality_z": k.expanding_zscore(x), "stability": 1 - dev / (F.abs(mean) + 1e-8),
        "value_rank": k.rolling_percentile_rank(x, 252), "slope": k.rolling_slope(x, quarter), "surprise": F.col(x) - mean,
    }).withColumn("slope_change", F.col("slope") - before("slope", quarter))


def environment(df: DataFrame, columns: list[str]) -> DataFrame:
    """60-row z of market series (20 at least; 0 where it can't be told) and their mean. ``df`` has one row a date."""
    w = Window.orderBy(DATE).rowsBetween(-59, 0)
    z = {f"{c}_z": F.coalesce(F.when(F.count(c).over(w) >= 20, F.try_divide(F.col(c) - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)))), F.lit(0.0)) for c in columns}
    out = df.withColumns(z)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(f"{c}_z")
    return out.withColumn("composite", total / len(columns))


def flow_ratios(tiers: list[str], main: str, close: str) -> dict[str, Column]:
    """Each tier over the sum of absolute tiers, and the main flow per unit of price."""
    total = F.lit(0.0)
    for t in tiers:
        total = total + F.abs(F.coalesce(t, F.lit(0.0)))
    return {f"{t}_ratio": F.try_divide(F.col(t), total) for t in tiers} | {"main_by_price": F.try_divide(F.col(main), F.abs(F.col(close)))}


def lockups(events: DataFrame, as_of, half_life: float = 180.0) -> DataFrame:
    """Per entity: pressure of unlocks after ``as_of`` decayed by their distance, days to the next, and their number.

    The reference date is a parameter; nothing here looks at the clock.
    """
    days = F.date_diff(DATE, F.lit(as_of).cast("date"))
    ahead = events.withColumn("_d", days).where("_d >= 0")
    return ahead.groupBy(ENTITY).agg(F.sum(F.col("ratio") * F.exp(-math.log(2) / half_life * F.col("_d"))).alias("pressure"), F.min("_d").alias("next_days"), F.count("*").alias("unlocks"))


def block_windows(premium: str, amount: str, turnover: str) -> dict[str, Column]:
    """6-row variation of the premium (3 at least), its change, whether it is deep, and amount over turnover."""
    cv = F.try_divide(at_least(premium, 6, 3, F.stddev_pop), F.abs(at_least(premium, 6, 3)))
    return {"premium_cv": cv, "premium_change": F.try_divide(F.col(premium) - before(premium), before(premium)), "deep": (F.col(premium) < -8).cast("int"), "amount_share": clip(F.try_divide(F.col(amount), F.col(turnover)), 0.0, 1.0)}


def board_momentum(df: DataFrame, board: str, change: str, spans=(63, 126, 252)) -> DataFrame:
    """Sums of a board's change over its own rows."""
    w = Window.partitionBy(board).orderBy(DATE)
    out = {}
    for d in spans:
        f = w.rowsBetween(1 - d, 0)
        out[f"mom_{d}"] = F.when(F.count(change).over(f) >= max(5, d // 4), F.sum(change).over(f))
    return df.withColumns(out)


def trailing_mean(x: str, d: int = 60) -> Column:
    """Mean of what is there in the last d sessions of the dense grid; 0 without any."""
    return F.coalesce(F.avg(x).over(last_rows(d)), F.lit(0.0))


def age(df: DataFrame, x: str) -> DataFrame:
    """The latest value and its age in days, effective from the session after it is known."""
    known = F.last(F.when(F.col(x).isNotNull(), F.struct(F.col(DATE).alias("d"), F.col(x).alias("v"))), ignorenulls=True).over(per_entity().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_k", known)
    return df.withColumns({f"{x}_held": F.col("_k.v"), f"{x}_age": F.date_diff(DATE, "_k.d")}).drop("_k")


def with_momentum_grid(dense: DataFrame, lookback: int = 20) -> DataFrame:
    df = dense.withColumn("_h", F.last("close", ignorenulls=True).over(so_far())).withColumn("_p", before("_h"))
    df = df.withColumn("_r", F.coalesce(F.try_divide(F.col("_h"), F.col("_p")) - 1, F.lit(0.0)))
    return df.withColumn("momentum", F.avg("_r").over(per_entity().rowsBetween(-lookback, -1))).drop("_h", "_p", "_r")


def concept_stats(rows: DataFrame, concept: str, hit: Column, height: str) -> DataFrame:
    """Per (date, concept): hits, share of the concept's size, greatest height; joined back to each row."""
    size = rows.groupBy(concept).agg(F.count_distinct(ENTITY).alias("size"))
    by = rows.groupBy(DATE, concept).agg(F.count_if(hit).alias("hits"), F.max(F.when(hit, F.col(height))).alias("top"))
    both = by.join(size, concept).withColumn("hit_share", F.col("hits") / F.col("size"))
    return rows.join(both, [DATE, concept], "left")


def feature_ic(df: DataFrame, features: list[str], outcome: str, least: int = 20) -> DataFrame:
    """Per feature: mean and deviation of the daily rank correlation with the outcome, their ratio, share above 0, days.

    Features are unpivoted, so one pass of ranks serves all of them.
    """
    long = df.where(F.col(outcome).isNotNull()).unpivot([ENTITY, DATE, outcome], features, "feature", "value").where("value is not null")
    by = Window.partitionBy("feature", DATE)

    def rank(c: str) -> Column:
        return F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("feature", DATE, c)) - 1) / 2.0

    daily = long.withColumns({"_a": rank("value"), "_b": rank(outcome)}).groupBy("feature", DATE).agg(F.count("*").alias("n"), F.when(F.min("value") < F.max("value"), correlation("_a", "_b")).alias("ic"))
    good = daily.where((F.col("n") >= least) & F.col("ic").isNotNull())
    return good.groupBy("feature").agg(F.count("*").alias("days"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("dev"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg(F.when(F.round("ic", 12) > 0, 1.0).otherwise(0.0)).alias("positive"))


def selected(ic: DataFrame, top: int) -> DataFrame:
    """The features with the greatest absolute mean correlation; ties by name."""
    return ic.orderBy(F.desc(F.abs("mean")), "feature").limit(top)


def ridge(df: DataFrame, features: list[str], outcome: str, penalty: float = 1.0) -> dict[str, float]:
    """Ridge weights from normal equations: one aggregate of products, solved for the few features on the driver."""
    import numpy as np

    rows = df.where(" and ".join(f"{c} is not null" for c in [*features, outcome]))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    s = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs), *(F.sum(F.col(a) * F.col(outcome)).alias(f"{a}__y") for a in features)).first()
    if s[0] is None:
        return dict.fromkeys(features, 0.0)
    x = np.zeros((len(features), len(features)))
    for a, b in pairs:
        x[features.index(a), features.index(b)] = x[features.index(b), features.index(a)] = s[f"{a}__{b}"]
    w = np.linalg.solve(x + penalty * np.eye(len(features)), np.array([s[f"{a}__y"] for a in features]))
    return dict(zip(features, w.tolist(), strict=True))


def point_in_time_ratio(prices: DataFrame, facts: DataFrame, value: str, most: float = 10_000.0) -> DataFrame:
    """Close over the latest disclosed value; NULL where it is not positive or absurd."""
    from stratagrid.operators.channels import as_of

    both = as_of(prices, facts, [value])
    q = F.try_divide(F.col("close"), F.col(value))
    return both.withColumn("ratio", F.when((F.col(value) > 0) & (q > 0) & (q <= most), q))


def effective_size(series: DataFrame, r: str, lags: int = 5) -> DataFrame:
    """n / (1 + 2 sum of positive weighted autocorrelations) of a daily series (a row a day)."""
    w = Window.orderBy(DATE)
    df = series.select(DATE, r, *(F.lag(r, i).over(w).alias(f"l{i}") for i in range(1, lags + 1)))
    s = df.agg(F.count(r).alias("n"), *(correlation(r, f"l{i}").alias(f"c{i}") for i in range(1, lags + 1)))
    total = F.lit(0.0)
    for i in range(1, lags + 1):
        total = total + (1 - i / (lags + 1.0)) * F.greatest(F.lit(0.0), F.coalesce(F.col(f"c{i}"), F.lit(0.0)))
    return s.select("n", (F.col("n") / (1 + 2 * total)).alias("effective"))


def noise(df: DataFrame, columns: list[str], level: float, seed: int) -> DataFrame:
    """Columns with seeded Gaussian noise relative to the date's deviation."""
    return df.withColumns({c: F.col(c) + F.randn(seed + i) * level * F.coalesce(F.stddev_pop(c).over(per_date()), F.lit(0.0)) for i, c in enumerate(columns)})
