"""Grouped aggregates: market breadth, event days, ladders, sparsity, coverage and drift reports.

Plain ``groupBy`` throughout: Spark aggregates on the map side first. Orders that decide something
(leaders, vocabularies, modes) end in a unique key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY
from stratagrid.operators.selection import positions
from stratagrid.session import stored, tasks_for


def block_days(events: DataFrame, premium: str, amount: str, volume: str, note: str, marks: dict[str, str]) -> DataFrame:
    """Per (date, entity): count, mean premium, sums, amount-weighted premium, and whether any note matches each mark."""
    flags = [F.bool_or(F.col(note).rlike(p)).alias(k) for k, p in marks.items()]
    vwap = F.coalesce(F.try_divide(F.sum(F.col(premium) * F.col(amount)), F.sum(amount)), F.avg(premium))
    return events.groupBy(DATE, ENTITY).agg(F.count("*").alias("n"), F.avg(premium).alias("premium"), F.sum(amount).alias("amount"), F.sum(volume).alias("volume"), vwap.alias("vwap_premium"), *flags)


def ranked_seats(events: DataFrame, buy: str, sell: str) -> DataFrame:
    """Per (date, entity): net, and buying's share of both sides plus one."""
    b, s = F.sum(buy), F.sum(sell)
    return events.groupBy(DATE, ENTITY).agg((b - s).alias("net"), (b / (b + s + 1)).alias("buy_share"), F.lit(1).alias("listed"))


def long_to_wide(rows: DataFrame, flags: list[str], means: list[str], rest: list[str]) -> DataFrame:
    """Many labels per (date, entity) to one row: flags by maximum, means by mean, others by their smallest value."""
    return rows.groupBy(DATE, ENTITY).agg(*(F.max(c).alias(c) for c in flags), *(F.avg(c).alias(c) for c in means), *(F.min(c).alias(c) for c in rest))


def dispersion(rows: DataFrame, x: str) -> DataFrame:
    """Per date: share of gains, mean, deviation, extremes, unbiased skew and the 20-day deviation of the deviation."""
    n = F.count(x)
    skew = F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2))
    by = rows.groupBy(DATE).agg((F.count_if(F.col(x) > 0) / n).alias("share_up"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("dev"), F.max(x).alias("top"), F.min(x).alias("bottom"), skew.alias("skew"))
    w = Window.orderBy(DATE).rowsBetween(-19, 0)  # one row a date
    return by.withColumn("dev_of_dev", F.when(F.count("dev").over(w) == 20, F.stddev_samp("dev").over(w)))


def breadth(rows: DataFrame, amount: str, change: str) -> DataFrame:
    """Per date: turnover, its 20-day z, and the share of rows that rose."""
    by = rows.groupBy(DATE).agg(F.sum(amount).alias("turnover"), F.try_divide(F.count_if(F.col(change) > 0).cast("double"), F.count(change).cast("double")).alias("advance"))
    w = Window.orderBy(DATE).rowsBetween(-19, 0)  # one row a date
    return by.withColumn("turnover_z", F.when(F.count("turnover").over(w) == 20, F.try_divide(F.col("turnover") - F.avg("turnover").over(w), F.stddev_samp("turnover").over(w))))


def flow_by_group(rows: DataFrame, group: str, amount: str, change: str, item: str) -> DataFrame:
    """Per (date, group): amount signed by the change, and how many items."""
    return rows.groupBy(DATE, group).agg(F.sum(F.col(amount) * F.signum(change)).alias("flow"), F.count_distinct(item).alias("items"))


def ladder(rows: DataFrame, height: str, broken: Column, change: str, edge: float) -> DataFrame:
    """Per date: share broken, greatest height, share that advanced by ``edge``, and counts of heights 2, 3, 4, 5, 6 and more."""
    step = [F.count_if(F.col(height) == k).alias(f"h{k}") for k in (2, 3, 4, 5)]
    return rows.groupBy(DATE).agg(F.avg(F.when(broken, 100.0).otherwise(0.0)).alias("break_rate"), F.max(height).alias("top"), F.avg(F.when(F.col(change) >= edge, 1.0).otherwise(0.0)).alias("advance"), *step, F.count_if(F.col(height) >= 6).alias("h6_up"))


def vocabulary(rows: DataFrame, label: str, least: int, most: int) -> DataFrame:
    """The ``most`` frequent labels with at least ``least`` rows; ties by name."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), label).limit(most)


def multi_hot(rows: DataFrame, label: str, words: list[str]) -> DataFrame:
    """One 0/1 column for each word, by (date, entity)."""
    return rows.groupBy(DATE, ENTITY).agg(*(F.max(F.when(F.col(label) == w, 1).otherwise(0)).alias(f"cb_{j}") for j, w in enumerate(words)))


def mode_of(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Each key's most frequent label, ties by name."""
    n = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), label))
    return n.withColumn("_r", first).where("_r = 1").select(key, label, "n")


def concepts(rows: DataFrame, board: str, momentum: str) -> DataFrame:
    """Per (date, entity): boards, mean and greatest momentum, boards in the date's top tenth, mean rank share."""
    held = rows.select(DATE, ENTITY, board, momentum)
    dealt = held.repartition(tasks_for(rows), DATE)  # whole dates, so their number of rows in a task doesn't grow with the table
    by = Window.partitionBy(DATE)
    # of equal values the first has the rank, the last the rank's end: one sort gives both
    upto = by.orderBy(momentum).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumns({"_first": F.rank().over(by.orderBy(momentum)), "_last": F.count(F.lit(1)).over(upto), "_n": F.count(F.lit(1)).over(by)})
    pct = (F.col("_first") + (F.col("_last") - F.col("_first")) / 2.0) / F.col("_n")
    return ranked.withColumn("_p", pct).groupBy(DATE, ENTITY).agg(F.count(board).alias("boards"), F.avg(momentum).alias("mean_mom"), F.max(momentum).alias("max_mom"), F.count_if(F.col("_p") > 0.9).alias("hot"), F.avg("_p").alias("heat"))


def sparsity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of rows that are not 0, share of entities on which it never moves, and a tier."""
    long = rows.unpivot([ENTITY], columns, "feature", "value")
    by = long.groupBy("feature", ENTITY).agg(F.count_if(F.coalesce(F.col("value"), F.lit(0.0)) != 0).alias("nz"), F.count("*").alias("n"), (F.min("value") == F.max("value")).cast("int").alias("flat"))
    out = by.groupBy("feature").agg((F.sum("nz") / F.sum("n")).alias("nonzero"), F.avg(F.coalesce("flat", F.lit(1))).alias("flat_share"))
    return out.withColumn("tier", F.when(F.col("nonzero") < 0.01, "dead").when(F.col("nonzero") < 0.2, "sparse").otherwise("dense"))


def coverage(rows: DataFrame, x: str) -> DataFrame:
    """Per entity: days, days with a value, share, mean and deviation."""
    return rows.groupBy(ENTITY).agg(F.count("*").alias("days"), F.count(x).alias("with_data"), (F.count(x) / F.count("*")).alias("share"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("dev"))


def quality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing share and its tier, infinite values, share of different values."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("e")).select("e.*")
    inf = F.abs("value") == float("inf")
    by = long.groupBy("feature").agg((1 - F.count("value") / F.count("*")).alias("missing"), F.count_if(inf).alias("infinite"), (F.count_distinct("value") / F.count("*")).alias("unique_share"))
    return by.withColumn("tier", F.when(F.col("missing") > 0.5, "bad").when(F.col("missing") > 0.2, "poor").otherwise("good"))


def sigma_drift(base: DataFrame, now: DataFrame, columns: list[str], limit: float = 3.0, least: int = 10) -> DataFrame:
    """Per column: shift of the mean in population deviations of the base, and whether it is a drift."""

    def moments(df: DataFrame, tag: str) -> DataFrame:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")).select("e.*")
        return long.groupBy("feature").agg(F.avg("v").alias(f"m{tag}"), F.stddev_pop("v").alias(f"s{tag}"), F.count("v").alias(f"n{tag}"))

    both = moments(base, "0").join(moments(now, "1"), "feature")
    shift = F.try_divide(F.abs(F.col("m1") - F.col("m0")), F.col("s0"))
    return both.select("feature", shift.alias("shift"), F.coalesce((shift >= limit) & (F.least("n0", "n1") >= least), F.lit(False)).alias("drift"))


def ks(base: DataFrame, now: DataFrame, x: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples: counts by value first, then running shares over the values."""
    both = base.select(F.col(x).alias("v"), F.lit(0).alias("side")).unionByName(now.select(F.col(x).alias("v"), F.lit(1).alias("side"))).where("v is not null")
    at = both.groupBy("v").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    # cut the line of values into ranges, so that no task sorts all of them
    cuts = both.select(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("q"))
    at = at.withColumn("q", cuts.scalar()).withColumn("cell", F.size(F.filter("q", lambda q: q < F.col("v")))).drop("q")
    cells = at.groupBy("cell").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    w = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 64 cells
    offsets = cells.select("cell", F.coalesce(F.sum("ca").over(w), F.lit(0)).alias("oa"), F.coalesce(F.sum("cb").over(w), F.lit(0)).alias("ob"))
    inside = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = at.join(F.broadcast(offsets), "cell").select((F.col("oa") + F.sum("a").over(inside)).alias("ra"), (F.col("ob") + F.sum("b").over(inside)).alias("rb"))
    total = cells.agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    return run.agg(F.max(F.abs(F.col("ra") / total.select("na").scalar() - F.col("rb") / total.select("nb").scalar())).alias("ks"))


def quantiles(rows: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """One row, ``e``: the interpolated quantiles of ``x`` without NULL, in the order of ``shares``; empty without any value.

    Values are counted first and counts added up by ranges (``positions``), so no task holds all values.
    """
    at = positions(rows.where(F.col(x).isNotNull()).groupBy(F.lit("x").alias("feature"), F.col(x).cast("double").alias("value")).agg(F.count("*").alias("n")))
    place = lambda p: (F.col("total") - 1) * F.lit(float(p))
    inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    ends = [(f(place(p)), f"{n}{i}") for i, p in enumerate(shares) for n, f in (("low", F.floor), ("high", F.ceil))]
    few = at.where(functools.reduce(lambda a, b: a | b, (inside(k) for k, _ in ends)))
    one = few.agg(F.max("total").alias("total"), *(F.max(F.when(inside(k), F.col("value"))).alias(n) for k, n in ends))

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        return F.when(low == high, low).otherwise((F.ceil(place(p)) - place(p)) * low + (place(p) - F.floor(place(p))) * high)

    return one.select(F.array_compact(F.array(*(between(i, p) for i, p in enumerate(shares)))).alias("e"))


def psi(base: DataFrame, now: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Population stability index on pooled decile edges, from density histograms."""
    both = base.select(F.col(x).alias("v"), F.lit(0).alias("side")).unionByName(now.select(F.col(x).alias("v"), F.lit(1).alias("side"))).where("v is not null")
    both = stored(both)  # read twice: for the edges and for the counts
    edges = quantiles(both, "v", [i / bins for i in range(bins + 1)]).select(F.array_sort(F.array_distinct("e")).alias("e"))
    put = both.withColumn("e", edges.scalar()).withColumn("k", F.least(F.size("e") - 2, F.size(F.filter("e", lambda q: q <= F.col("v"))) - 1))
    by = put.groupBy("k").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.max(F.get("e", F.col("k") + 1) - F.get("e", F.col("k"))).alias("width"))
    w = Window.partitionBy()  # at most ``bins`` rows
    p, q = (F.col(c) / F.sum(c).over(w) / F.col("width") + 1e-10 for c in ("a", "b"))
    return by.withColumns({"p": p, "q": q}).agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def sector_median(rows: DataFrame, x: str, sector: str = "sector") -> DataFrame:
    return rows.groupBy(DATE, sector).agg(F.median(x).alias("median"))


def full_outer_series(parts: dict[str, DataFrame]) -> DataFrame:
    """Daily counts of several event tables side by side, 0 where one has none: one union and one aggregate instead of outer joins."""
    out = None
    for name, df in parts.items():
        one = df.select(DATE, *(F.lit(1 if k == name else 0).alias(k) for k in parts))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(DATE).agg(*(F.sum(k).alias(k) for k in parts))


def trailing_twelve(rows: DataFrame, x: str, floor: float = 0.001) -> DataFrame:
    """Twelve-month value from values that accumulate within a year: the year's own in month 12, else last year's total plus this year's part less the same part a year ago."""
    w = Window.partitionBy(ENTITY).orderBy("report_date")
    year_end = F.last(F.when(F.month("report_date") == 12, F.col(x)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ago = rows.select(ENTITY, F.add_months("report_date", 12).alias("report_date"), F.col(x).alias("_ago"))
    out = rows.withColumn("_fy", year_end).join(ago, [ENTITY, "report_date"], "left")
    ttm = F.when(F.month("report_date") == 12, F.col(x)).when(F.col("_fy").isNull(), F.lit(None)).otherwise(F.col("_fy") + F.col(x) - F.coalesce("_ago", F.lit(0.0)))
    return out.withColumn("ttm", F.when(ttm.isNotNull(), F.greatest(ttm, F.lit(floor)))).drop("_fy", "_ago")


def refresh_plan(rows: DataFrame, target, shards: int = 4) -> DataFrame:
    """Entities whose last stored date lies before ``target``, with the next date to fetch and a shard."""
    last = rows.groupBy(ENTITY).agg(F.max(DATE).alias("stored"))
    return last.where(F.col("stored") < F.lit(target).cast("date")).select(ENTITY, "stored", F.date_add("stored", 1).alias("next"), F.pmod(F.col(ENTITY), F.lit(shards)).alias("shard"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, share: float, seed: int) -> DataFrame:
    """A fixed share of keys of every stratum, at least one each, in hash order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(stratum)
    n = F.count(F.lit(1)).over(w)
    return rows.withColumn("_r", F.row_number().over(w.orderBy(order, key))).withColumn("_k", F.greatest(F.lit(1), F.floor(n * F.lit(share)))).where("_r <= _k").drop("_r", "_k")
