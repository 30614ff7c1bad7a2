"""Side channels joined to bars: fill, lag, staleness, as-of and interval joins.

Event channels fill gaps with 0, state channels carry the last value on; both are then moved one bar
row on, so that a bar never sees its own day's value. All joins are equi-joins on (entity, date), on
entity, or unions sorted once per entity; Spark chooses how to run them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, before, per_entity, so_far


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def joined(bars: DataFrame, aux: DataFrame, columns: list[str]) -> DataFrame:
    return bars.join(aux.select(ENTITY, DATE, *columns), [ENTITY, DATE], "left")


def event_channel(bars: DataFrame, aux: DataFrame, columns: list[str], lag: int = 1) -> DataFrame:
    """Left join; gaps are 0; values arrive ``lag`` bars later."""
    out = joined(bars, aux, columns)
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in columns}
    return out.withColumns({c: F.coalesce(F.lag(v, lag).over(per_entity()), F.lit(0.0)) if lag else v for c, v in filled.items()})


def state_channel(bars: DataFrame, aux: DataFrame, columns: list[str], lag: int = 1, stale_after: int | None = None) -> DataFrame:
    """Left join; gaps carry the last value on; values arrive ``lag`` bars later.

    With ``stale_after`` also: days since the last observation, whether there was one, days since the
    first, and whether it is older than that.
    """
    out = joined(bars, aux, columns).withColumn("_seen", F.when(F.coalesce(*(F.col(c).isNotNull() for c in columns)), F.col(DATE)))
    held = {c: F.last(c, ignorenulls=True).over(so_far()) for c in columns} | {"_last": F.last("_seen", ignorenulls=True).over(so_far()), "_first": F.min("_seen").over(so_far())}
    out = out.withColumns(held)
    if lag:
        out = out.withColumns({c: before(c, lag) for c in [*columns, "_last", "_first"]})
    if stale_after is not None:
        age = F.date_diff(DATE, "_last")
        out = out.withColumns({"days_since": age, "ever_seen": F.col("_last").isNotNull(), "days_since_first": F.date_diff(DATE, "_first"), "is_stale": F.coalesce(age > stale_after, F.lit(True))})
    return out.drop("_seen", "_last", "_first")


def as_of(left: DataFrame, right: DataFrame, columns: list[str], key: str = ENTITY, at: str = DATE) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row at or before it, by one union and one sort per key."""
    empty = [F.lit(None).cast(dict(right.dtypes)[c]).alias(f"_{c}") for c in columns]
    rows = left.select(F.struct(*left.columns).alias("_row"), key, at, F.lit(1).alias("_side"), F.lit(None).cast("boolean").alias("_there"), *empty)
    facts = right.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), key, at, F.lit(0).alias("_side"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in columns))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_there"), F.struct(*(f"_{c}" for c in columns))), ignorenulls=True).over(w)
    return rows.unionByName(facts).withColumn("_held", held).where("_side = 1").select("_row.*", *(F.col(f"_held._{c}").alias(c) for c in columns))


def expiring_as_of(left: DataFrame, right: DataFrame, columns: list[str], max_days: int) -> DataFrame:
    """As-of by column, each ignoring NULLs; a value older than ``max_days`` calendar days is gone."""
    rows = left.select(F.struct(*left.columns).alias("_row"), ENTITY, DATE, F.lit(1).alias("_side"), *(F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in columns))
    facts = right.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), ENTITY, DATE, F.lit(0).alias("_side"), *columns)
    w = Window.partitionBy(ENTITY).orderBy(DATE, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(facts)
    for c in columns:
        seen = F.last(F.when(F.col(c).isNotNull(), F.col(DATE)), ignorenulls=True).over(w)
        both = both.withColumn(f"_{c}", F.when(F.date_diff(DATE, seen) <= max_days, F.last(c, ignorenulls=True).over(w)))
    return both.where("_side = 1").select("_row.*", *(F.col(f"_{c}").alias(c) for c in columns))


def covering(rows: DataFrame, intervals: DataFrame, begin: str = "in_date", end: str = "out_date", slack: str = "month") -> DataFrame:
    """``rows`` joined to the half-open intervals that cover them; a NULL end is open.

    Intervals are cut at calendar months, so the join is an equi-join on (entity, month) with a filter
    and never compares an entity's rows with all of its intervals.
    """
    last = rows.agg(F.max(DATE).alias("d"))
    cut = intervals.withColumn("_until", F.least(F.coalesce(F.date_sub(end, 1), last.scalar()), last.scalar())).where(F.col("_until") >= F.col(begin))
    cut = cut.withColumn("_m", F.explode(F.sequence(F.trunc(begin, slack), F.trunc("_until", slack), F.expr("interval 1 month")))).drop("_until")
    inside = (F.col(DATE) >= F.col(begin)) & (F.col(end).isNull() | (F.col(DATE) < F.col(end)))
    return rows.withColumn("_m", F.trunc(DATE, slack)).join(cut, [ENTITY, "_m"]).where(inside).drop("_m")


def member_flag(rows: DataFrame, intervals: DataFrame, name: str = "is_member") -> DataFrame:
    """Whether any interval covers each row; overlapping intervals count once."""
    hit = covering(rows.select(ENTITY, DATE), intervals).select(ENTITY, DATE).distinct().withColumn(name, F.lit(True))
    return rows.join(hit, [ENTITY, DATE], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def member_counts(rows: DataFrame, intervals: DataFrame, days: int = 30) -> DataFrame:
    """How many intervals cover each row, whether any does, and the change over the last ``days`` rows (0 until full)."""
    n = covering(rows.select(ENTITY, DATE), intervals).groupBy(ENTITY, DATE).agg(F.count("*").alias("n_covering"))
    out = rows.join(n, [ENTITY, DATE], "left").withColumn("n_covering", F.coalesce("n_covering", F.lit(0)))
    step = out.withColumn("_d", F.col("n_covering") - before("n_covering"))
    w = per_entity().rowsBetween(1 - days, 0)
    return step.withColumns({"covered": F.col("n_covering") > 0, "change": F.when(F.count("_d").over(w) == days, F.sum("_d").over(w)).otherwise(0)}).drop("_d")


def date_broadcast(rows: DataFrame, series: DataFrame, columns: list[str]) -> DataFrame:
    """A market-wide series (one row a date) on every row of its date."""
    return rows.join(series.select(DATE, *columns), DATE, "left")


def valid_from(rows: DataFrame, mapping: DataFrame, columns: list[str], since: str = "valid_from") -> DataFrame:
    """A static mapping by entity, NULL before the date it is valid from."""
    out = rows.join(mapping.select(ENTITY, since, *columns), ENTITY, "left")
    return out.withColumns({c: F.when(F.col(DATE) >= F.col(since), F.col(c)) for c in columns}).drop(since)


def in_pool(rows: DataFrame, pool: DataFrame, name: str = "in_pool") -> DataFrame:
    """Whether (entity, date) stands in ``pool``, however often."""
    hit = pool.select(ENTITY, DATE).distinct().withColumn(name, F.lit(True))
    return rows.join(hit, [ENTITY, DATE], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def rebased(primary: DataFrame, backfill: DataFrame) -> DataFrame:
    """Primary rows, and backfilled ones scaled by the median ratio of closes where both exist.

    The factor is one number per entity; dates that the primary has are removed by an anti join.
    """
    both = primary.select(ENTITY, DATE, F.col("close").alias("_p")).join(backfill.select(ENTITY, DATE, F.col("close").alias("_b")), [ENTITY, DATE])
    ratio = both.groupBy(ENTITY).agg(F.median(F.try_divide("_p", "_b")).alias("_r"))
    rest = backfill.join(primary.select(ENTITY, DATE), [ENTITY, DATE], "left_anti").join(ratio, ENTITY)
    return primary.select(ENTITY, DATE, "close").unionByName(rest.select(ENTITY, DATE, (F.col("close") * F.col("_r")).alias("close")))


def last_write_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union of both with one row per key, the new one where both have it."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_batch").drop("_batch")


def replaced_range(old: DataFrame, new: DataFrame, low, high) -> DataFrame:
    """``old`` without the dates in [low, high], and ``new``, without repeated rows."""
    kept = old.where(~F.col(DATE).between(F.lit(low), F.lit(high)))
    return kept.unionByName(new).dropDuplicates()


def spells(snapshots: DataFrame, months: int = 1) -> DataFrame:
    """Monthly presence (entity, month) as validity intervals: a gap of more than ``months`` starts a new one.

    The last month of a spell that reaches the last month of the table leaves it open.
    """
    w = Window.partitionBy(ENTITY).orderBy("month")
    gap = F.months_between("month", F.lag("month").over(w)) > months
    island = F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(w)
    end = snapshots.agg(F.max("month").alias("m"))
    by = snapshots.distinct().withColumn("_i", island).groupBy(ENTITY, "_i").agg(F.min("month").alias("in_date"), F.max("month").alias("_last"))
    return by.select(ENTITY, "in_date", F.when(F.col("_last") < end.scalar(), F.add_months("_last", 1)).alias("out_date"))


def changes_to_intervals(events: DataFrame, value: str) -> DataFrame:
    """Change events (entity, date, value) as [date, next date) intervals; runs of one value are merged."""
    w = per_entity()
    moved = events.withColumn("_new", F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True))).where("_new")
    return moved.select(ENTITY, value, F.col(DATE).alias("in_date"), F.lead(DATE).over(w).alias("out_date"))


def segments(rows: DataFrame, *by: str) -> DataFrame:
    """Runs of neighbouring rows of an entity that agree in ``by``: start, end and rows of each."""
    w = per_entity()
    same = F.struct(*by) == F.struct(*(F.lag(c).over(w) for c in by))
    island = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(so_far())
    return rows.withColumn("_i", island).groupBy(ENTITY, "_i", *by).agg(F.min(DATE).alias("start"), F.max(DATE).alias("end"), F.count("*").alias("rows")).drop("_i")


def on_calendar(rows: DataFrame, calendar: DataFrame, order: str) -> DataFrame:
    """Rows on known sessions only, the last of each (entity, date); first of all operators, as one stray date spoils a cross-section."""
    return keep_last(rows.join(calendar.select(DATE), DATE, "left_semi"), [ENTITY, DATE], order)


def bounded_fill(bars: DataFrame, aux: DataFrame, column: str, rows: int) -> DataFrame:
    """The last value, but for at most ``rows`` bar rows after it."""
    out = joined(bars, aux, [column]).withColumn("_rn", F.row_number().over(per_entity()))
    at = F.last(F.when(F.col(column).isNotNull(), F.col("_rn")), ignorenulls=True).over(so_far())
    return out.withColumn(column, F.when(F.col("_rn") - at <= rows, F.last(column, ignorenulls=True).over(so_far()))).drop("_rn")
