"""The sleeve account: h overlapping books, each opened with 1/h of the account and held h sessions.

What a day's purchases bring back depends on their budget only as a factor: sold on one day, they return the
budget times a number that Spark adds up over the names. So the account's fold over days runs over one row
for each pair of a day of purchase and a day of sale, however many names were bought; the budgets it
finds, one a day, go back to the positions by a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, per_date
from stratagrid.operators.corruption import uniform


def orders(dense: DataFrame, score: str, fraction: float, horizon: int) -> DataFrame:
    """What is bought: the best k names of each date by score, filled at the next session's open, sold ``horizon`` sessions later.

    ``dense`` has every session of an entity. A missing exit price is delayed to the next real open;
    without any later one the position is unresolved and valued at its last close.
    """
    w = Window.partitionBy(ENTITY).orderBy(DATE)
    n = F.count(F.col(score)).over(per_date())
    k = F.greatest(F.lit(1), F.least(n, F.bround(n * F.lit(fraction))))
    place = F.row_number().over(Window.partitionBy(DATE).orderBy(F.desc_nulls_last(score), ENTITY))
    # rows to come, last one first: a frame that grows is one step a row, one that shrinks is all rows again
    after = Window.partitionBy(ENTITY).orderBy(F.desc(DATE)).rowsBetween(Window.unboundedPreceding, -horizon - 1)
    df = dense.withColumns({
        "_k": k, "_p": place, "bought": F.lead(DATE, 1).over(w), "entry": F.lead("open", 1).over(w),
        "_exit": F.last(F.when(F.col("open").isNotNull(), F.struct(F.col(DATE).alias("d"), F.col("open").alias("o"))), ignorenulls=True).over(after), "_due": F.lead(DATE, horizon + 1).over(w),
        "_last": F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    held = df.where(F.col(score).isNotNull() & (F.col("_p") <= F.col("_k")) & F.col("entry").isNotNull())
    outcome = F.when(F.col("_exit").isNull(), "unresolved").when(F.col("_exit.d") > F.col("_due"), "delayed").otherwise("sold")
    return held.select(ENTITY, F.col(DATE).alias("decided"), "bought", "entry", F.col("_exit.d").alias("sold"), F.coalesce("_exit.o", "_last").alias("leave"), outcome.alias("outcome"))


BUDGETS = "date date, budget double, nav double, cash double, positions int, exposure double"


def flows(bought: DataFrame) -> DataFrame:
    """bought, sold, n, gain (sum of leave by entry) and names (all of the day): a row a pair of days."""
    by = bought.groupBy("bought", "sold").agg(F.count("*").alias("n"), F.sum(F.col("leave") / F.col("entry")).alias("gain"))
    return by.withColumn("names", F.sum("n").over(Window.partitionBy("bought")))


def budgets(bought: DataFrame, horizon: int, cost: float = 5e-4) -> DataFrame:
    """By day with a purchase or a sale: what was spent, and the account's value at cost, cash, positions and exposure.

    The fold's rows are as many as pairs of days, a few times the calendar; names have been added up before.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buys = {d: g["names"].iloc[0] for d, g in pdf.groupby("bought")}
        sales = {d: list(zip(g["bought"], g["n"], g["gain"], strict=True)) for d, g in pdf.dropna(subset=["sold"]).sort_values("bought").groupby("sold")}
        cash, held, count, spent, out = 1.0, 0.0, 0, {}, []
        for day in sorted({*buys, *sales}):
            for of, n, gain in sales.get(day, ()):
                unit = spent[of] / (buys[of] * (1 + cost))  # shares times entry of each name
                cash += unit * gain * (1 - cost)
                held -= unit * n
                count -= n
            if day in buys:
                spent[day] = min((cash + held) / horizon, cash)
                cash -= spent[day]
                held += spent[day] / (1 + cost)
                count += buys[day]
            held = held if count else 0.0
            out.append((day, spent.get(day), cash + held, cash, int(count), held / (cash + held)))
        return pd.DataFrame(out, columns=["date", "budget", "nav", "cash", "positions", "exposure"])

    return flows(bought).groupBy(F.lit(1).alias("book")).applyInPandas(run, BUDGETS)


def daily(bought: DataFrame, horizon: int, cost: float = 5e-4) -> DataFrame:
    """The account by day: value at cost, cash, positions and exposure."""
    return budgets(bought, horizon, cost).select(DATE, "nav", "cash", "positions", "exposure")


def ledger(bought: DataFrame, horizon: int, cost: float = 5e-4) -> DataFrame:
    """One row per filled position: its share of its day's budget, what it cost and brought."""
    spent = budgets(bought, horizon, cost).where("budget is not null").select(F.col(DATE).alias("bought"), "budget")
    names = bought.groupBy("bought").agg(F.count("*").alias("_n"))
    held = bought.join(spent.join(names, "bought"), "bought")
    value = F.col("budget") / (F.col("_n") * (1 + cost))
    held = held.withColumn("shares", value / F.col("entry"))
    gain = F.col("shares") * F.col("leave")
    paid = value * cost + F.when(F.col("sold").isNotNull(), gain * cost).otherwise(0.0)
    return held.select(F.col(ENTITY).cast("long").alias(ENTITY), "bought", "sold", "shares", "entry", "leave", paid.alias("cost"), (gain - value - paid).alias("pnl"), "outcome")


def blended(a: DataFrame, b: DataFrame, w_a: float, w_b: float) -> DataFrame:
    """Two books without rebalancing: the weighted sum of their curves, by date."""
    both = a.select(DATE, F.col("equity").alias("ea")).join(b.select(DATE, F.col("equity").alias("eb")), DATE)
    return both.select(DATE, (w_a * F.col("ea") + w_b * F.col("eb")).alias("equity"))


def resampled(returns: DataFrame, r: str, rounds: int = 2000, block: int = 1, seed: int = 42) -> DataFrame:
    """round and m: the mean of a daily series resampled in blocks of days, as often as it is long.

    A block's start is a hash of the seed, the round and the block's number, so rounds are the same after a retry and on any
    number of partitions. Days are numbered (a row a day) and joined to the days that rounds pick.
    """
    days = returns.where(F.col(r).isNotNull()).select((F.row_number().over(Window.orderBy(DATE)) - 1).alias("i"), F.col(r).alias("v"))
    n = days.agg(F.count("*").alias("n"))
    picks = returns.sparkSession.range(rounds).select(F.col("id").alias("round"), n.scalar().alias("n")).where("n > 0")
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.lit(float(block))) - 1).cast("int"))))
    begin = F.floor(uniform(seed, "round", "j") * F.greatest(F.lit(1), F.col("n") - block + 1))
    length = F.least(F.lit(block), F.col("n") - F.col("j") * block).cast("int")
    picks = picks.select("round", F.explode(F.sequence(begin, begin + length - 1)).alias("i"))
    return picks.join(days, "i").groupBy("round").agg(F.avg("v").alias("m"))


def bootstrap_mean(returns: DataFrame, r: str, rounds: int = 2000, block: int = 1, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Confidence interval of a daily series' mean from resampled blocks of days."""
    each = resampled(returns, r, rounds, block, seed)
    return each.agg(F.count("*").alias("rounds"), F.avg("m").alias("mean"), F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
