"""Operators over all entities of a date, and of a (date, sector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.ranks import average_rank, centred_rank, normal_quantile
from stratagrid.functions.rolling import last
from stratagrid.functions.windows import DATE, clip, col, correlation, per_date

FEW = 5


def date_wise_z(df: DataFrame, x: str, member: str | None = None, name: str = "z") -> DataFrame:
    """z by date, from members only if ``member`` names a flag; all rows are scored.

    Dates with fewer than FEW values use the pooled moments (population deviation) of all rows up to
    the date instead. Moments are one map-side aggregate per date; what is joined back is one row a
    date.
    """
    v = F.when(F.col(member), F.col(x)) if member else F.col(x)
    by = df.groupBy(DATE).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("dev"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
    upto = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    n, s1, s2 = (F.sum(c).over(upto) for c in ("n", "s1", "s2"))
    pooled = by.withColumns({"pn": n, "pm": s1 / n, "pv": F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))})
    few = F.col("n") < FEW
    moments = pooled.select(F.col(DATE).alias("_d"), F.when(few, F.col("pm")).otherwise(F.col("mean")).alias("_m"), F.when(few, F.sqrt("pv")).otherwise(F.coalesce("dev", F.lit(1.0))).alias("_s"))
    joined = df.join(moments, F.col(DATE) == F.col("_d"), "left")
    return joined.withColumn(name, (F.col(x) - F.col("_m")) / F.greatest("_s", F.lit(1e-8))).drop("_d", "_m", "_s")


def sector_neutral(x: str, sector: str = "sector") -> Column:
    """Difference to the (date, sector) median where the sector has two names or more."""
    w = per_date(sector)
    return F.when(F.count(F.col(x)).over(w) >= 2, F.col(x) - F.median(x).over(w)).otherwise(F.col(x))


def size_neutral(df: DataFrame, x: str, size: str, name: str = "residual", least: int = 10) -> DataFrame:
    """Residual of x on 1, s, s^2 by date, from centred sums: one aggregate, no group in one task."""
    mean = df.groupBy(DATE).agg(F.avg(size).alias("_c"), F.count(F.col(x)).alias("_n"), F.avg(x).alias("_x")).withColumnRenamed(DATE, "_d")
    rows = df.join(mean, F.col(DATE) == F.col("_d")).drop("_d").withColumns({"_s": F.col(size) - F.col("_c"), "_y": F.col(x) - F.col("_x")})
    w = per_date()
    s2, s3, s4, sy, s2y = (F.sum(e).over(w) for e in (F.pow("_s", F.lit(2)), F.pow("_s", F.lit(3)), F.pow("_s", F.lit(4)), F.col("_s") * F.col("_y"), F.pow("_s", F.lit(2)) * F.col("_y")))
    n = F.col("_n")
    rows = rows.withColumns({"_a": s2, "_b": s3, "_e": s4 - s2 * s2 / n, "_f": sy, "_g": s2y})
    det = F.col("_a") * F.col("_e") - F.col("_b") * F.col("_b")
    b1, b2 = F.try_divide(F.col("_f") * F.col("_e") - F.col("_g") * F.col("_b"), det), F.try_divide(F.col("_a") * F.col("_g") - F.col("_b") * F.col("_f"), det)
    fit = b1 * F.col("_s") + b2 * (F.pow("_s", F.lit(2)) - F.col("_a") / n)
    return rows.withColumn(name, F.when(n >= least, F.col("_y") - fit).otherwise(F.col(x))).drop("_c", "_n", "_x", "_s", "_y", "_a", "_b", "_e", "_f", "_g")


def rank_normal(x: str) -> Column:
    """Average rank by date, mapped to normal scores; 0 for a single name, NULL for NULL."""
    n = F.count(F.col(x)).over(per_date()).cast("double")
    p = F.greatest(1 / (n + 1), F.least(1 - 1 / (n + 1), (average_rank(x, DATE) - 0.5) / n))
    return F.when(n < 2, F.lit(0.0)).when(F.col(x).isNotNull(), normal_quantile(p))


def with_rank_normal(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with ``rank_normal``; its window values are columns first, as the quantile names the share many times and each would be a window of its own."""
    v, all_ = F.col(x), per_date()
    up, down = F.rank().over(all_.orderBy(F.asc_nulls_last(x))), F.rank().over(all_.orderBy(F.desc_nulls_last(x)))
    ranked = df.withColumns({"_n": F.count(v).over(all_).cast("double"), "_up": up, "_down": down})
    share = ranked.withColumn("_p", F.greatest(1 / (F.col("_n") + 1), F.least(1 - 1 / (F.col("_n") + 1), ((F.col("_n") + 1 + F.col("_up") - F.col("_down")) / 2.0 - 0.5) / F.nullif("_n", F.lit(0.0)))))
    return share.withColumn(name, F.when(F.col("_n") < 2, F.lit(0.0)).when(v.isNotNull(), normal_quantile(F.col("_p")))).drop("_n", "_up", "_down", "_p")


def plain_z(x: str) -> Column:
    dev = F.stddev_samp(x).over(per_date())
    return (F.col(x) - F.avg(x).over(per_date())) / F.when(dev == 0, F.lit(1.0)).otherwise(dev)


def adaptive_strength(x: str) -> Column:
    """x stretched by up to half where its recent deviation departs from the longer one."""
    fast, slow = (last(F.stddev_samp, d, x) for d in (20, 60))
    return F.col(x) * (1 + 0.5 * F.coalesce(clip(F.try_divide(fast - slow, slow), -0.5, 1.0), F.lit(0.0)))


def relative_to_sector(x: str, sector: str = "sector") -> Column:
    """Ratio to the (date, sector) median; 1 where the median is next to 0."""
    m = F.median(x).over(per_date(sector))
    return F.when(F.abs(m) <= 1e-8, F.lit(1.0)).otherwise(F.col(x) / F.when(F.abs(m) <= 1e-8, F.lit(1.0)).otherwise(m))


def above_quantile(x: str, p: float) -> Column:
    return F.col(x) > F.percentile(x, F.lit(p)).over(per_date())


def quantile_rank(x: str) -> Column:
    """Average rank over count among values above 0; 0.5 for a single one."""
    good = F.when(F.col(x) > 0, F.col(x))
    n = F.count(good).over(per_date())
    return F.when(n == 1, F.when(F.col(x) > 0, 0.5)).otherwise(average_rank("_good", DATE) / n)


def with_quantile_rank(df: DataFrame, x: str, name: str = "qr") -> DataFrame:
    return df.withColumn("_good", F.when(F.col(x) > 0, F.col(x))).withColumn(name, quantile_rank(x)).drop("_good")


def target_z(x: str, least: int = 5) -> Column:
    w = per_date()
    return F.when(F.count(F.col(x)).over(w) >= least, (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(1e-8)))


def sector_strength(df: DataFrame, change: str, sector: str = "sector") -> DataFrame:
    """Per (date, sector): mean change, strength against the market, breadth, alpha, leader and rank."""
    by = df.groupBy(DATE, sector).agg(
        F.avg(change).alias("mean_change"), F.stddev_samp(change).alias("dev"), F.count(change).alias("n"), F.count_if(F.col(change) > 0).alias("up"), F.count_if(F.col(change) < 0).alias("down"),
        F.max(F.struct(F.col(change), (-F.col("entity")).alias("e")))["e"].alias("leader"),
    )
    market = F.avg("mean_change").over(per_date())
    return by.withColumns({
        "strength": F.col("mean_change") - market, "breadth": F.try_divide((F.col("up") - F.col("down")).cast("double"), (F.col("up") + F.col("down")).cast("double")), "leader": -F.col("leader"),
        "rank": F.rank().over(Window.partitionBy(DATE).orderBy(F.desc("mean_change"))), "alpha": F.when(F.count(F.lit(1)).over(per_date()) < 3, 0.0).otherwise(F.col("mean_change") - market),
    })


def daily_rank_ic(df: DataFrame, score: str, outcome: str, least: int = 10) -> DataFrame:
    """Spearman correlation of score and outcome for each date with ``least`` names and a score that varies.

    Ranks are taken after the pool is filtered. They are centred whole numbers, so their sums are exact and a
    correlation of 0 is 0 in whatever order rows come.
    """
    pool = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    ranked = pool.withColumns({"_a": centred_rank(score, DATE), "_b": centred_rank(outcome, DATE)})
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    by = ranked.groupBy(DATE).agg(F.count("*").alias("n"), F.try_divide(total("_a", "_b").cast("double"), F.sqrt(total("_a", "_a")) * F.sqrt(total("_b", "_b"))).alias("ic"))
    return by.where((F.col("n") >= least) & F.col("ic").isNotNull())


def quintiles(df: DataFrame, score: str, outcome: str, buckets: int = 5) -> DataFrame:
    """Mean outcome of each score bucket: by date first, then over dates."""
    pool = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    cut = pool.withColumn("bucket", F.ntile(buckets).over(Window.partitionBy(DATE).orderBy(score, "entity")))
    daily = cut.groupBy(DATE, "bucket").agg(F.avg(outcome).alias("m"))
    return daily.groupBy("bucket").agg(F.avg("m").alias("mean_outcome"), F.count("*").alias("days"))


def sign_agreement(columns: list[str]) -> dict[str, Column]:
    """Over columns of a row: shares of positive and negative ones, mean sign, and relative dispersion."""
    held = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda v: v.isNotNull())
    n = F.size(held).cast("double")
    total = lambda f: F.aggregate(held, F.lit(0.0), lambda a, v: a + f(v))
    mean = total(lambda v: v) / n
    dev = F.sqrt(total(lambda v: (v - mean) * (v - mean)) / n)
    return {
        "share_up": total(lambda v: F.when(v > 0, 1.0).otherwise(0.0)) / n, "share_down": total(lambda v: F.when(v < 0, 1.0).otherwise(0.0)) / n,
        "mean_sign": total(lambda v: F.signum(v)) / n, "dispersion": dev / (total(F.abs) / n + 1e-10),
    }


def top_k(df: DataFrame, score: str, fraction: float, name: str = "side") -> DataFrame:
    """Long and short side by date: k = max(1, min(n / 2, rounded share)) names each."""
    n = F.count(F.col(score)).over(per_date())
    k = F.greatest(F.lit(1), F.least(F.floor(n / 2), F.bround(n * F.lit(fraction))))
    best = F.row_number().over(Window.partitionBy(DATE).orderBy(F.desc(score), "entity"))
    worst = F.row_number().over(Window.partitionBy(DATE).orderBy(score, "entity"))
    return df.where(F.col(score).isNotNull()).withColumns({"_k": k, "_b": best, "_w": worst}).withColumn(name, F.when(F.col("_b") <= F.col("_k"), "long").when(F.col("_w") <= F.col("_k"), "short")).drop("_k", "_b", "_w")


def sectors(supplier: DataFrame) -> DataFrame:
    """entity and its sector, the supplier's nation; one row per supplier, smaller than the bars by its days."""
    return supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("sector"))


def with_sector(df: DataFrame, supplier: DataFrame) -> DataFrame:
    return df.join(sectors(supplier), "entity", "left")


def size_proxy() -> Column:
    return F.ln(F.greatest(col("close") * F.col("volume"), F.lit(1.0)))
