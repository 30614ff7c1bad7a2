"""Evaluation of daily series: information coefficients, account curves and risk figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.ranks import normal_cdf


def ic_summary(ic: DataFrame, horizon: int = 1) -> DataFrame:
    """One row: days, mean, population deviation, ratio, share above 0 and Newey-West t (Bartlett weights).

    ``ic`` has one row a date, so its order is one small sort; the products with earlier days are a
    self-join on the day's number.
    """
    o = ic.select("ic", F.row_number().over(Window.orderBy("date")).alias("i"))
    t = o.agg(F.count("*").alias("days"), F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("dev"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive"))
    lags = F.greatest(F.lit(horizon - 1), F.floor(4 * F.pow(F.col("days") / 100.0, F.lit(2.0 / 9))).cast("int"))
    t = t.withColumn("lags", lags)
    each = t.select("days", "mean", "lags", F.explode(F.sequence(F.lit(0), "lags")).alias("k"))
    a, b = o.select(F.col("ic").alias("x"), F.col("i").alias("ia")), o.select(F.col("ic").alias("y"), F.col("i").alias("ib"))
    pairs = a.join(F.broadcast(each)).join(b, F.col("ib") == F.col("ia") - F.col("k"))  # ``each`` has a row per lag
    gamma = pairs.groupBy("k").agg((F.sum((F.col("x") - F.col("mean")) * (F.col("y") - F.col("mean"))) / F.max("days")).alias("gamma"), F.max("lags").alias("lags"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("lags") + 1.0)))
    var = gamma.agg(F.sum(weight * F.col("gamma")).alias("v"))
    return t.withColumn("v", var.scalar()).select("days", "mean", "dev", F.try_divide("mean", "dev").alias("ir"), "positive", F.try_divide(F.col("mean"), F.sqrt(F.col("v") / F.col("days"))).alias("t_stat"))


def portfolio_returns(df: DataFrame, score: str, outcome: str, horizon: int = 5, top: float = 0.1, pool: Column | None = None) -> DataFrame:
    """By date: the mean outcome of the best and of the worst names and their difference, for books that are renewed every ``horizon`` sessions.

    Dates are numbered from 0; ``phase`` is the number modulo ``horizon``, and ``place`` orders all dates by phase and
    date, as the phases' series are put one behind the other. Of the n names in the pool with a finite score and
    outcome, a share of ``top`` (half at most, one at least) makes each book; ties go by entity. Dates
    with fewer than two such names have no row but keep their number.
    """
    dates = df.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))  # a row a date
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    named = df.where(finite(score) & finite(outcome) & (F.lit(True) if pool is None else F.coalesce(pool, F.lit(False))))
    by = Window.partitionBy("date")
    ranked = named.withColumns({"_n": F.count("*").over(by), "_r": F.row_number().over(by.orderBy(F.desc(score), "entity"))}).where("_n >= 2")
    size = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") / 2), F.rint(F.lit(top) * F.col("_n")).cast("long")))
    ranked = ranked.withColumn("_k", size)
    books = ranked.groupBy("date").agg(
        F.max("_n").alias("n"), F.max("_k").alias("k"), F.avg(F.when(F.col("_r") <= F.col("_k"), F.col(outcome))).alias("long"), F.avg(F.when(F.col("_r") > F.col("_n") - F.col("_k"), F.col(outcome))).alias("short")
    )
    out = books.join(dates, "date").withColumn("phase", F.col("i") % horizon)
    place = F.row_number().over(Window.orderBy("phase", "date")) - 1  # a row a date
    return out.select("date", "phase", place.alias("place"), "n", "k", "long", "short", (F.col("long") - F.col("short")).alias("spread"))


def equity(returns: DataFrame, r: str = "r") -> DataFrame:
    """date, r, equity (from 1) and drawdown of a daily series of returns."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.select("date", F.col(r).alias("r"), F.exp(F.sum(F.ln(F.greatest(1 + F.col(r), F.lit(1e-12)))).over(upto)).alias("equity"))
    return curve.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(upto)) - 1)


def risk(returns: DataFrame, horizon: int = 1, r: str = "r") -> DataFrame:
    """One row: days, mean, Sharpe, Sortino, worst drawdown, Calmar, profit factor and final equity."""
    year = 252.0 / horizon
    scale = year**0.5
    stats = equity(returns, r).agg(
        F.count("*").alias("days"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("dev"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), F.lit(2)))).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.sum(F.greatest("r", F.lit(0.0))).alias("gain"), F.sum(F.greatest(-F.col("r"), F.lit(0.0))).alias("loss"), F.max_by("equity", "date").alias("final"),
    )
    cagr = F.pow("final", F.lit(year) / F.col("days")) - 1
    return stats.select(
        "days", "mean", F.try_divide(F.col("mean"), F.col("dev")).alias("ratio"), (F.try_divide(F.col("mean"), F.col("dev")) * scale).alias("sharpe"), (F.try_divide(F.col("mean"), F.col("down")) * scale).alias("sortino"),
        "max_drawdown", F.try_divide(cagr, -F.col("max_drawdown")).alias("calmar"), F.try_divide("gain", "loss").alias("profit_factor"), "final",
    )


def probabilistic_sharpe(returns: DataFrame, benchmark: float = 0.0, r: str = "r") -> DataFrame:
    """Probability that the true per-period Sharpe ratio exceeds ``benchmark``, given skew and kurtosis."""
    s = returns.agg(F.count(r).alias("n"), (F.avg(r) / F.stddev_samp(r)).alias("sr"), F.skewness(r).alias("g3"), (F.kurtosis(r) + 3).alias("g4"))
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr"))
    return s.select("n", "sr", "g3", "g4", normal_cdf(z).alias("psr"))


def confusion(df: DataFrame, truth: str, guess: str, ignore: int = -100) -> DataFrame:
    return df.where((F.col(truth) != ignore) & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("y"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy, macro precision and recall, F1 of these, and the multi-class correlation (MCC).

    Everything follows from the confusion counts, one row for each pair of classes.
    """
    m = confusion(df, truth, guess)
    rows = m.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    cols = m.groupBy(F.col("g").alias("k")).agg(F.sum("n").alias("p"))
    by = rows.join(cols, "k", "full_outer").select("k", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("t", "p", "hit")))
    s = by.agg(
        F.sum("t").alias("total"), F.sum("hit").alias("right"), F.avg(F.coalesce(F.try_divide("hit", "p"), F.lit(0.0))).alias("precision"), F.avg(F.coalesce(F.try_divide("hit", "t"), F.lit(0.0))).alias("recall"),
        F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    n2 = F.col("total") * F.col("total")
    return s.select(
        (F.col("right") / F.col("total")).alias("accuracy"), "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        F.coalesce(F.try_divide(F.col("right") * F.col("total") - F.col("tp"), F.sqrt((n2 - F.col("pp")) * (n2 - F.col("tt")))), F.lit(0.0)).alias("mcc"),
    )


def fill_probability(df: DataFrame, decided: Column, filled: Column) -> DataFrame:
    """By date: rows decided on, and the share of them that was filled."""
    return df.groupBy("date").agg(F.count_if(decided).alias("decided"), F.try_divide(F.count_if(decided & filled).cast("double"), F.count_if(decided).cast("double")).alias("p_fill"))


def walk_forward(calendar: DataFrame, train: int, val: int, step: int, purge: int) -> DataFrame:
    """fold, role and date of every session in each fold: ``train`` sessions, a purge, ``val`` sessions, moved on by ``step``."""
    numbered = calendar.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    n = numbered.agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - train - purge - val) / F.lit(float(step))).cast("int")
    folds = n.where(F.col("n") >= train + purge + val).select(F.explode(F.sequence(F.lit(0), last)).alias("fold"))
    begin = F.col("fold") * step
    role = F.when((F.col("i") >= begin) & (F.col("i") < begin + train), "train").when((F.col("i") >= begin + train + purge) & (F.col("i") < begin + train + purge + val), "val")
    return numbered.join(folds, (F.col("i") >= begin) & (F.col("i") < begin + train + purge + val)).select("fold", role.alias("role"), "date").where("role is not null")
