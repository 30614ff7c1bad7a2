"""Time-axis features beyond the technical set: flows, events, streaks, outliers, gaps, targets and masks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from stratagrid.functions.ranks import unbiased_kurtosis, unbiased_skew
from stratagrid.functions.rolling import last, mad, quantile, rolled
from stratagrid.functions.windows import DATE, ENTITY, at_least, before, clip, col, full, last_rows, per_entity, returns, so_far

LAGS = (1, 2, 3, 5, 10, 20)


def bias(periods=(5, 10, 20, 60)) -> dict[str, Column]:
    """Distance of the close from its mean, in percent."""
    return {f"bias_{p}": F.try_divide(F.col("close") - full("close", p), full("close", p)) * 100 for p in periods}


def lags(columns: list[str], steps=LAGS) -> dict[str, Column]:
    return {f"{c}_lag{k}": before(c, k) for c in columns for k in steps}


def shock(x: str) -> dict[str, Column]:
    """Volume against the median of up to 20 rows before (5 at least), and counts of anomalies."""
    past = per_entity().rowsBetween(-20, -1)
    base = F.when(F.count(x).over(past) >= 5, F.percentile(x, F.lit(0.5)).over(past))
    return {"shock": F.coalesce(clip(F.try_divide(F.col(x), base), 0.0, 20.0), F.lit(1.0))}


def intensity(x: str) -> dict[str, Column]:
    """z over 20 rows (5 at least), clipped to 5, and whether it is extreme."""
    z = clip((F.col(x) - at_least(x, 20, 5)) / (at_least(x, 20, 5, F.stddev_pop) + 1e-8), -5.0, 5.0)
    return {"flow_z": z, "flow_extreme": (F.abs(z) > 1.8).cast("int")}


def persistence(x: str, spans=(5, 10, 20)) -> dict[str, Column]:
    return {f"inflow_{d}": F.sum(F.when(F.col(x) > 0, 1).otherwise(0)).over(last_rows(d)) for d in spans}


def divergence(df: DataFrame, x: str, r: str, d: int = 5, least: int = 3) -> DataFrame:
    """Whether the last return and the last d-row flow sum stand on different sides of their recent means."""
    df = df.withColumn("_sum", at_least(x, d, 1, F.sum))

    def z_last(c: str) -> Column:
        w = last_rows(d)
        ok = (F.count(c).over(w) == F.count(F.lit(1)).over(w)) & (F.count(c).over(w) >= least)
        dev = F.stddev_pop(c).over(w)
        return F.when(ok & (dev >= 1e-12), (F.col(c) - F.avg(c).over(w)) / F.when(dev >= 1e-12, dev)).otherwise(0.0)

    df = df.withColumns({"_zr": z_last(r), "_zf": z_last("_sum")})
    return df.withColumn("divergence", (F.signum("_zr") != F.signum("_zf")).cast("int")).drop("_sum", "_zr", "_zf")


def residual(x: str, on: str, least: int = 10) -> Column:
    """x less its regression on ``on`` over the entity's whole history (it looks ahead: a label, not a feature)."""
    w = Window.partitionBy(ENTITY)
    n = F.count(F.when(F.col(x).isNotNull() & F.col(on).isNotNull(), 1)).over(w)
    return F.when(n >= least, F.col(x) - (F.regr_slope(x, on).over(w) * F.col(on) + F.regr_intercept(x, on).over(w))).otherwise(F.col(x))


def runs(df: DataFrame, flag: Column, name: str = "run") -> DataFrame:
    """Length of the current run of rows where ``flag`` holds, 0 outside; and its 20-row maximum."""
    hit = F.coalesce(flag, F.lit(False))
    df = df.withColumn("_hit", hit).withColumn("_isle", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(so_far()))
    inside = Window.partitionBy(ENTITY, "_isle").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(name, F.sum(F.col("_hit").cast("int")).over(inside))
    return df.withColumn(f"{name}_max20", F.max(name).over(last_rows(20))).drop("_hit", "_isle")


def event_time(df: DataFrame, x: str) -> DataFrame:
    """Rows since the last event (-1 before the first), events and their size in 20 rows, last direction."""
    rn = F.row_number().over(per_entity())
    hit = F.coalesce(F.col(x) != 0, F.lit(False))
    df = df.withColumns({"_rn": rn, "_hit": hit})
    return df.withColumns({
        "days_since": F.coalesce(F.col("_rn") - F.last(F.when(F.col("_hit"), F.col("_rn")), ignorenulls=True).over(so_far()), F.lit(-1)),
        "count_20": F.sum(F.col("_hit").cast("int")).over(last_rows(20)), "intensity_20": F.sum(F.when(F.col("_hit"), F.abs(x)).otherwise(0.0)).over(last_rows(20)),
        "last_direction": F.coalesce(F.last(F.when(F.col("_hit"), F.signum(x)), ignorenulls=True).over(so_far()), F.lit(0.0)),
    }).drop("_rn", "_hit")


def holders(x: str) -> dict[str, Column]:
    """Concentration z over 8 rows (4 at least), change to 4 rows before, mean of 60 (20 at least)."""
    z = -(F.col(x) - at_least(x, 8, 4)) / (at_least(x, 8, 4, F.stddev_pop) + 1e-8)
    return {"hn_z": z, "yoy": F.try_divide(F.col(x) - before(x, 4), before(x, 4)), "sma_60": at_least(x, 60, 20)}


def decayed(value: Column, days: Column, half_life: float) -> Column:
    """value * exp(-ln 2 / half_life * days)."""
    return value * F.exp(-math.log(2) / half_life * days)


def yields(df: DataFrame, y: str, half_life: float = 365.0) -> DataFrame:
    """Days since the last positive yield, and that yield decayed by them."""
    seen = F.last(F.when(F.col(y) > 0, F.struct(F.col(DATE).alias("d"), F.col(y).alias("y"))), ignorenulls=True).over(so_far())
    df = df.withColumn("_seen", seen)
    days = F.date_diff(DATE, "_seen.d")
    return df.withColumns({"days_since_yield": days, "effective_yield": decayed(F.col("_seen.y"), days, half_life), "recent_yield": F.coalesce(days <= 90, F.lit(False))}).drop("_seen")


def variation(x: str, d: int, least: int) -> Column:
    """Coefficient of variation with population deviation."""
    return F.try_divide(at_least(x, d, least, F.stddev_pop), F.abs(at_least(x, d, least)))


def momentum(x: str, spans=(5, 20, 60, 252)) -> dict[str, Column]:
    return {f"mom_{d}": at_least(x, d, max(5, d // 4), F.sum) for d in spans}


def rotation(df: DataFrame, x: str, by: str = DATE) -> DataFrame:
    """Relative rotation: y is the date's z of the 252-row sum (63 at least), x its change over 10 rows, and the quadrant."""
    df = df.withColumn("_sum", at_least(x, 252, 63, F.sum))
    w = Window.partitionBy(by)
    df = df.withColumn("rrg_y", (F.col("_sum") - F.avg("_sum").over(w)) / (F.stddev_samp("_sum").over(w) + 1e-8))
    df = df.withColumn("rrg_x", F.col("rrg_y") - before("rrg_y", 10))
    return df.withColumn("quadrant", F.when(F.col("rrg_x") > 0, 2).otherwise(0) + F.when(F.col("rrg_y") > 0, 1).otherwise(0)).drop("_sum")


def text_windows(x: str, spans=(3, 5, 10, 20)) -> dict[str, Column]:
    return {f"{k}_{d}": at_least(x, d, max(1, d // 3), f) for d in spans for k, f in (("mean", F.avg), ("std", F.stddev_samp))}


def higher_order() -> dict[str, Column]:
    """Needs ``ret``: unbiased skew and kurtosis, realised volatility, drawdown, share of gains, illiquidity, distance to VWAP."""
    ten = lambda x: F.when(last(F.count, 20, "ret") >= 10, x)
    return {
        "skew_20": ten(unbiased_skew("ret", 20)), "kurt_20": ten(unbiased_kurtosis("ret", 20)), "rv_20": ten(F.sqrt(last(F.sum, 20, F.col("ret") * F.col("ret")))),
        "drawdown_20": F.col("close") / last(F.max, 20, "close") - 1, "up_ratio_20": ten(last(F.avg, 20, F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0))),
        "amihud": F.abs("ret") / (F.col("close") * F.col("volume") + 1), "vwap_gap": F.try_divide(F.col("close") * F.col("volume"), F.col("amount")) - 1,
    }


def outlier_clip(df: DataFrame, x: str, k: float = 5.0, d: int = 252, least: int = 10) -> DataFrame:
    """x held within median +- k MAD of the last d rows (itself among them), from row ``least`` on."""

    def clipped() -> dict[str, Column]:
        mid, far, n = last(quantile(0.5), d, x), last(mad, d, x), last(F.count, d, x)
        held = F.greatest(mid - k * far, F.least(mid + k * far, F.col(x)))
        return {f"{x}_clip": F.when((n >= least) & (far > 1e-12) & F.col(x).isNotNull(), held).otherwise(F.col(x))}

    return rolled(df, clipped)


def robust_scale(df: DataFrame, x: str, d: int = 252, least: int = 63, also: Callable[[], dict[str, Column]] = dict) -> DataFrame:
    """Clipped to mean +- 3 deviations, then (x - median) / (1.4826 MAD + eps), in +-1e4; ``also`` gives more columns of the same last pass."""

    def held() -> dict[str, Column]:
        mean, dev = at_least(x, d, least), at_least(x, d, least, F.stddev_samp)
        return {"_c": F.when(mean.isNotNull() & dev.isNotNull() & F.col(x).isNotNull(), F.greatest(mean - 3 * dev, F.least(mean + 3 * dev, F.col(x)))).otherwise(F.col(x))}

    def scaled() -> dict[str, Column]:
        mid, n = last(quantile(0.5), d, "_c"), last(F.count, d, "_c")
        eps = F.greatest(1e-3 * F.abs(mid), F.lit(1e-6))
        return {f"{x}_rs": F.when(n >= least, clip((F.col("_c") - mid) / (1.4826 * last(mad, d, "_c") + eps), -1e4, 1e4))} | also()

    return rolled(rolled(df, held), scaled).drop("_c")


def gap_lengths(df: DataFrame, x: str) -> DataFrame:
    """``gap``: length of the run of NULLs that a row is in; 0 for a value."""
    df = df.withColumn("_i", F.count(x).over(so_far()))
    run = Window.partitionBy(ENTITY, "_i")
    return df.withColumn("gap", F.when(F.col(x).isNull(), F.count_if(F.col(x).isNull()).over(run)).otherwise(0)).drop("_i")


def _gains(n: int) -> list[float]:
    """How far a local level moves to the second and each further of ``n`` values: state variance 0.1, noise 1, from 1."""
    var, out = 1.0, []
    for _ in range(n - 1):
        var += 0.1
        out.append(var / (var + 1.0))
        var *= 1 - out[-1]
    return out


PAST = 5
GAINS = _gains(PAST)


def with_imputed(df: DataFrame, x: str, short: int = 2, long: int = 10) -> DataFrame:
    """``df`` with ``filled`` and ``has_gap``: gaps up to ``short`` carry the last value on, up to ``long`` a local-level forecast of the last PAST values, longer stay NULL.

    The level needs the last values only, so it is folded where a value is, over windows of the rows with one, and
    carried over the gap behind it. NaN is no value; before the first value nothing is filled, and one value alone is carried on.
    """
    rows = df.withColumn("_v", F.col(x).cast("double")).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    alike = Window.partitionBy(ENTITY, F.col("_v").isNull()).orderBy(DATE).rowsBetween(1 - PAST, 0)
    level = F.get("_past", F.lit(0))
    for i, gain in enumerate(GAINS, 1):
        level = F.when(F.size("_past") > i, level * (1 - gain) + F.get("_past", F.lit(i)) * gain).otherwise(level)
    held = rows.withColumn("_past", F.collect_list("_v").over(alike)).withColumn("_level", F.when(F.col("_v").isNotNull(), level)).drop("_past")
    held = held.withColumns({"_last": F.last("_v", ignorenulls=True).over(so_far()), "_level": F.last("_level", ignorenulls=True).over(so_far()), "_i": F.count("_v").over(so_far())})
    held = held.withColumn("_gap", F.count_if(F.col("_v").isNull()).over(Window.partitionBy(ENTITY, "_i")))
    fill = F.when(F.col("_gap") > long, None).when((F.col("_gap") <= short) | (F.col("_i") < 2), F.col("_last")).otherwise(F.col("_level"))
    return held.withColumns({"filled": F.coalesce("_v", fill), "has_gap": F.col("_v").isNull()}).drop("_v", "_level", "_last", "_i", "_gap")


def imputed(df: DataFrame, x: str, short: int = 2, long: int = 10) -> DataFrame:
    """entity, date, ``filled`` and ``has_gap`` alone, see ``with_imputed``."""
    return with_imputed(df.select(ENTITY, DATE, x), x, short, long).select(ENTITY, DATE, "filled", "has_gap")


#: Rows of the dense grid that a task holds, about; at least one entity.
GRID_ROWS = 1 << 18


def grid(bars: DataFrame) -> DataFrame:
    """Every (entity, session) from an entity's first bar on, with bars where they are: the dense calendar that targets need.

    Sessions are few (one row a date), numbered by the driver and sent to all tasks. Each bar unfolds the sessions up to its entity's next one
    in its own task, so nothing of the grid is joined or shuffled; tasks grow in number with the grid. Rows
    of no entity have no bars.
    """
    found = bars.agg(F.approx_count_distinct(ENTITY).alias("entities"), F.collect_set(DATE).alias("days")).first()
    days = sorted(found["days"])
    numbers = bars.sparkSession.createDataFrame([(d, i) for i, d in enumerate(days)], StructType([StructField("_d", bars.schema[DATE].dataType), StructField("_n", IntegerType())]))
    parts = max(1, math.ceil((found["entities"] + 1) * len(days) / GRID_ROWS))
    held = bars.join(F.broadcast(numbers), F.col(DATE) == F.col("_d")).drop("_d").repartition(parts, ENTITY).withColumn("_next", F.lead("_n").over(per_entity()))
    until = F.coalesce(F.col("_next") - 1, F.lit(len(days) - 1))
    rows = held.withColumn("_i", F.explode(F.sequence("_n", F.greatest("_n", until))))
    own = (F.col("_i") == F.col("_n")) & F.col(ENTITY).isNotNull()
    values = [F.when(own, F.col(c)).alias(c) for c in bars.columns if c not in (ENTITY, DATE)]
    dates = numbers.select(F.col("_d").alias("_date"), F.col("_n").alias("_at"))
    return rows.join(F.broadcast(dates), F.col("_i") == F.col("_at")).select(ENTITY, F.col("_date").alias(DATE), *values)


def targets(dense: DataFrame, h: int = 5) -> DataFrame:
    """Forward open-to-open return with carry to the last real close in (t, t + h], direction, and forward volatility.

    Rows must be the dense grid. These columns look ahead: labels only.
    """
    after = per_entity().rowsBetween(1, h)
    entry, leave = F.lead("open", 1).over(per_entity()), F.lead("open", h + 1).over(per_entity())
    carry = F.last("close", ignorenulls=True).over(after)
    fwd = F.try_divide(F.coalesce(leave, carry), entry) - 1
    edge = 0.003 * h**0.5
    r = returns("close")
    out = dense.withColumns({"fwd_return": F.when(entry.isNotNull() & carry.isNotNull(), fwd), "_r": r})
    enough = F.count("_r").over(after) >= max(2, -(-h // 2))
    return out.withColumns({
        "direction": F.when(F.col("fwd_return") > edge, 2).when(F.col("fwd_return") < -edge, 0).when(F.col("fwd_return").isNotNull(), 1),
        "fwd_vol": F.when(enough, F.stddev_pop("_r").over(after)),
    }).drop("_r")


def flat_target(h: int = 5, edge: float = 0.003) -> dict[str, Column]:
    r = (F.lead("close", h).over(per_entity()) - F.col("close")) / (F.col("close") + 1e-8)
    return {"flat_return": r, "label": F.when(r > edge, 2).when(r < -edge, 0).when(r.isNotNull(), 1)}


def eligibility(dense: DataFrame, seq: int = 60, least: int = 50, amount: float = 5e3, gap: int = 60) -> DataFrame:
    """What may be decided on at a session: seen the session before, enough history, liquid, not long suspended."""
    seen = F.col("close").isNotNull()
    df = dense.withColumn("_o", seen.cast("int"))
    history = F.sum("_o").over(per_entity().rowsBetween(-seq, -1))
    df = df.withColumns({"_amt": F.avg("amount").over(last_rows(60)), "_isle": F.sum("_o").over(so_far())})
    run = Window.partitionBy(ENTITY, "_isle").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_missing", F.sum(1 - F.col("_o")).over(run))
    halted = F.max(F.when(F.col("_missing") >= gap, 1).otherwise(0)).over(per_entity().rowsBetween(-gap, 0)) == 1
    return df.withColumns({
        "decided": F.coalesce(before("_o") == 1, F.lit(False)), "has_history": F.coalesce(history >= least, F.lit(False)), "liquid": F.coalesce(before("_amt") >= amount, F.lit(False)), "not_halted": ~halted,
    }).drop("_o", "_amt", "_isle", "_missing")


def intraday(events: DataFrame, x: str = "value") -> DataFrame:
    """Per (entity, day) of a tick table: place in the day, minutes since its start, opening move, running range position.

    The move from a first value of 0 is infinite (from 0 to 0: NaN), which isn't the NULL of a day with one value.
    """
    day = F.to_date("ts")
    df = events.withColumn("day", day)
    order = Window.partitionBy("entity", "day").orderBy("ts", "event_id")
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    minute = F.hour("ts") * 60 + F.minute("ts")
    top, bottom = F.max(x).over(run), F.min(x).over(run)
    first, second = F.first(x).over(whole), F.nth_value(x, 2).over(whole)
    of_zero = second * float("inf")  # at 0 the NaN of the processor, as a quotient of zeros is in SQL
    move = F.when(first == 0, of_zero).otherwise(F.try_divide(second, first) - 1)
    return df.withColumns({
        "bar_of_day": F.row_number().over(order), "minute": minute, "is_am": minute.between(571, 690), "is_pm": minute.between(781, 900), "opening_move": move,
        "range_position": F.when(top == bottom, 0.5).otherwise(F.try_divide(F.col(x) - bottom, top - bottom)),
    })


def sequence_summary(x: str, d: int = 20) -> dict[str, Column]:
    """Mean, population deviation, slope and first lags of the last d rows; needs ``rn``."""
    w = last_rows(d)
    return {"seq_mean": full(x, d), "seq_std": full(x, d, F.stddev_pop), "seq_slope": F.when(F.count(x).over(w) == d, F.regr_slope(x, "rn").over(w)), "seq_lag1": before(x), "seq_lag2": before(x, 2)}


def sequences(df: DataFrame, columns: list[str], d: int) -> DataFrame:
    """The last d rows of each full window as one array of arrays: the sample form of a model."""
    w = last_rows(d)
    held = F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(w)
    return df.withColumn("sequence", held).where(F.size("sequence") == d)


def pledges(df: DataFrame, amount: str, sign: Column) -> DataFrame:
    """Running balance of signed changes held at 0 or more (by the running minimum), and its 20-row maximum."""
    df = df.withColumn("_c", F.sum(sign * F.col(amount)).over(so_far()))
    low = F.least(F.lit(0.0), F.min("_c").over(so_far()))
    return df.withColumn("balance", F.col("_c") - low).withColumn("balance_max20", F.max("balance").over(last_rows(20))).drop("_c")


def expanding_share(x: str) -> Column:
    """x over its maximum so far."""
    return F.try_divide(F.col(x).cast("double"), F.max(col(x)).over(so_far()).cast("double"))
