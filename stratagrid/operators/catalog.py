"""The catalog of side channels and the driver that merges them onto bars in a fixed order.

A channel is a row of ``CHANNELS``: which columns it brings, whether a gap means nothing happened
(``event``) or nothing changed (``state``), whether its dates already are the days from which it may be
used, and after how many days a state is stale. All channels are joined first and then filled and lagged
in one pass of windows per entity, so their number adds joins but no further sorts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.windows import DATE, ENTITY, before, last_rows, so_far
from stratagrid.operators.channels import expiring_as_of

# Names of bars' own columns, which no channel may bring.
OWN = ("open", "high", "low", "close", "volume", "amount", "pct_change", "vol_change")
# Reasons of a listing among the day's largest moves.
REASONS = {"lhb_is_wave": "振幅|换手", "lhb_is_sustained": "连续", "lhb_is_drop": "跌幅|跌停|下跌"}


@dataclass(frozen=True)
class Channel:
    name: str
    columns: tuple[str, ...] = ()  #: none: all the source has, but for flags and bars' own columns
    state: bool = False
    lag: int = 1
    stale_after: int | None = None
    market_wide: bool = False  #: one row a date instead of one an entity and date
    extra: bool = False  #: further columns come along
    renamed: dict[str, str] = field(default_factory=dict)


# Columns, policies and limits in days of the channels, in the order in which they are merged.
CHANNELS = (
    Channel("sentiment", ("sentiment_mean", "sentiment_std", "news_count", "positive_ratio", "negative_ratio", "has_news"), lag=0, extra=True),
    Channel(
        "announcements", ("ann_sentiment_mean", "ann_sentiment_std", "ann_count", "ann_positive_ratio", "ann_negative_ratio", "has_announce"), extra=True,
        renamed={"sentiment_mean": "ann_sentiment_mean", "sentiment_std": "ann_sentiment_std", "announce_count": "ann_count", "positive_ratio": "ann_positive_ratio", "negative_ratio": "ann_negative_ratio"},
    ),
    Channel("margin", ("margin_balance", "margin_buy", "short_balance", "margin_net"), state=True, stale_after=5),
    Channel("northbound", ("north_hold_pct", "north_net_buy"), state=True, stale_after=5),
    Channel("dragon_tiger", ("lhb_net_amount", "lhb_buy_ratio", "lhb_present", "lhb_is_wave", "lhb_is_sustained", "lhb_is_drop")),
    Channel("fundamental", ("roe", "roa", "eps", "revenue_yoy", "profit_yoy", "debt_ratio", "gross_margin", "net_margin"), state=True, stale_after=120),
    Channel("earnings", ("has_forecast", "net_profit_yoy_low", "net_profit_yoy_high", "net_profit_low", "net_profit_high", "forecast_age"), state=True, lag=0, stale_after=120),
    Channel("valuation", ("pe_ttm", "pb_mrq", "ps_ttm", "pcf_ttm"), state=True, stale_after=5),
    Channel("etf_flow", ("sector_etf_flow", "sector_etf_amount")),
    Channel("guba", ("guba_sentiment_mean", "guba_sentiment_std", "guba_post_count", "guba_positive_ratio", "guba_negative_ratio", "has_guba_post"), lag=0, extra=True),
    Channel("comment", ("comment_score", "comment_attention", "comment_institution", "comment_trend", "has_comment"), extra=True),
    Channel("capital_flow"),
    Channel("block_trade"),
    Channel("shareholder", state=True, stale_after=120),
    Channel("lockup"),
    Channel("dividend"),
    Channel("board"),
    Channel("sector"),
    Channel("concept"),
    Channel(
        "macro", ("shibor_O_N", "shibor_1W", "shibor_2W", "shibor_1M", "shibor_3M", "shibor_6M", "shibor_9M", "shibor_1Y", "fx_usd_cny", "fx_eur_cny", "fx_jpy_cny", "fx_hkd_cny", "fx_gbp_cny", "bond_cn_2y", "bond_cn_5y", "bond_cn_10y", "bond_cn_30y", "bond_cn_10y2y_spread", "bond_us_2y", "bond_us_5y", "bond_us_10y", "bond_us_30y", "bond_us_10y2y_spread", "gdp_cn_yoy", "m2_yoy", "m1_yoy", "sf_total", "cpi_yoy"),
        state=True, stale_after=5, market_wide=True,
    ),
    Channel("industry", ("ind_pct_up", "ind_return_mean", "ind_return_std", "ind_return_max", "ind_return_min", "ind_return_skew", "ind_dispersion_20d"), state=True, stale_after=5, market_wide=True),
    Channel("limit_up"),
    Channel("pledge", state=True, stale_after=40),
    Channel("market_env", ("high_low_ratio", "market_adv_ratio", "market_turnover_z", "mkt_cap_total_z", "avg_account_cap_z", "investor_new_num", "investor_new_z"), state=True, stale_after=5, market_wide=True),
    Channel("index_membership"),
)
# Columns of ``market_env`` that come only if asked for, and the channel that is merged only if named.
ACCOUNT = ("mkt_cap_total_z", "avg_account_cap_z", "investor_new_num", "investor_new_z")
UNWIRED = ("limit_up",)


def kind(column: str) -> str:
    """``flag``, ``count`` or ``value``, by name; flags and counts are never carried on."""
    if column.startswith("has_"):
        return "flag"
    return "count" if column.endswith(("_count", "_streak", "_quadrant")) else "value"


def brought(ch: Channel, source: DataFrame, own: list[str], account: bool = False) -> list[str]:
    """The columns that ``source`` brings, by the channel's names."""
    there = [ch.renamed.get(c, c) for c in source.columns]
    free = [c for c in there if c not in ch.columns and c not in (ENTITY, DATE, *own, *OWN) and not c.startswith("has_")]
    named = [c for c in ch.columns if c in there and (account or ch.name != "market_env" or c not in ACCOUNT)]
    return named + (free if ch.extra or not ch.columns else [])


def last_by_key(source: DataFrame, keys: list[str], columns: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by ``order``, the greatest row where the source has no such column. Aggregated on the map side."""
    row = F.struct(*columns)
    held = F.max(row) if order not in source.columns else F.max(F.struct(F.col(order).alias("_order"), row.alias("_row")))["_row"]
    return source.groupBy(*keys).agg(held.alias("_row")).select(*keys, "_row.*")


def listed(seats: DataFrame) -> DataFrame:
    """Listings (entity, date, net_amount, buy_amount, sell_amount, lhb_reason) as one row a day."""
    flags = [F.max(F.coalesce(F.col("lhb_reason").rlike(p), F.lit(False)).cast("double")).alias(c) for c, p in REASONS.items()]
    bought, sold = F.coalesce(F.sum("buy_amount"), F.lit(0.0)), F.coalesce(F.sum("sell_amount"), F.lit(0.0))
    return seats.groupBy(ENTITY, DATE).agg(
        F.coalesce(F.sum("net_amount"), F.lit(0.0)).alias("lhb_net_amount"), (bought / (bought + sold + 1)).alias("lhb_buy_ratio"),
        (F.count("net_amount") > 0).cast("double").alias("lhb_present"), *flags,
    )


def disclosed(bars: DataFrame, facts: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """Quarterly facts on the bars' days from their ``disclose_date`` on, each column without limit."""
    facts = last_by_key(facts.withColumn(DATE, F.col("disclose_date").cast("date")), [ENTITY, DATE], columns, order)
    return expiring_as_of(bars.select(ENTITY, DATE), facts, columns, 1_000_000)


def _zero(c: str) -> Column:
    return F.lit({"flag": False, "count": 0, "value": 0.0}[kind(c)])


def _typed(c: str, x: Column | str | None = None) -> Column:
    return F.col(x or c).cast({"flag": "boolean", "count": "int", "value": "double"}[kind(c)])


def _arriving(x: Column, lag: int, zero: Column) -> Column:
    return F.coalesce(before(x, lag) if lag else x, zero)


def merged(bars: DataFrame, sources: dict[str, DataFrame], order: str | None = None, account: bool = False, names: tuple[str, ...] | None = None) -> DataFrame:
    """``bars`` with the columns of all channels in ``sources``, in the catalog's order.

    Repeated keys of a source keep their last row (``last_by_key``); a channel without any known column
    is left out; bars' own columns never come from a source. State channels also bring how old the state
    is, whether there was one, days since the first and whether it is stale, all as of the row before.
    ``names`` limits the channels; ``limit_up`` comes only if named there.
    """
    wanted = names if names is not None else tuple(c.name for c in CHANNELS if c.name not in UNWIRED)
    own, out, made = list(bars.columns), bars, {}
    for ch in CHANNELS:
        source = sources.get(ch.name)
        if source is None or ch.name not in wanted:
            continue
        if ch.name == "dragon_tiger" and "lhb_present" not in source.columns:
            source = listed(source)
        columns = brought(ch, source.drop("disclose_date", *([order] if order else [])), [*own, *made], account)
        if not columns:
            continue
        back = {v: k for k, v in ch.renamed.items() if k in source.columns}
        keys = [DATE] if ch.market_wide else [ENTITY, DATE]
        source = source.withColumns({c: _typed(c, back.get(c)) for c in columns})
        if "disclose_date" in source.columns:
            daily = disclosed(bars, source, columns, order)
        else:
            daily = last_by_key(source, keys, columns, order)
        values = [c for c in columns if kind(c) == "value"]
        out = out.join(daily, keys, "left")
        if ch.state and values:
            seen = F.coalesce(*(F.when(F.col(c).isNotNull(), F.col(DATE)) for c in values))
            out = out.withColumn(f"_seen_{ch.name}", seen)
        for c in columns:
            made[c] = (ch, F.last(c, ignorenulls=True).over(so_far()) if ch.state and kind(c) == "value" else F.coalesce(c, _zero(c)))
        if ch.state and values and ch.stale_after is not None:
            last, first = F.max(f"_seen_{ch.name}").over(so_far()), F.min(f"_seen_{ch.name}").over(so_far())
            made[f"{ch.name}_staleness_days"] = (ch, F.coalesce(F.date_diff(DATE, last), F.lit(0)))
            made[f"{ch.name}_has_ever_observed"] = (ch, last.isNotNull())
            made[f"{ch.name}_days_since_first_available"] = (ch, F.coalesce(F.date_diff(DATE, first), F.lit(0)))
            made[f"{ch.name}_is_stale"] = (ch, F.coalesce(F.date_diff(DATE, last) > ch.stale_after, F.lit(False)))
    filled = out.select(*own, *(x.alias(c) for c, (_, x) in made.items()))
    flags = ("_has_ever_observed", "_is_stale")
    zero = lambda c: F.lit(False) if c.endswith(flags) else F.lit(0) if c.endswith(("_staleness_days", "_days_since_first_available")) else _zero(c)
    done = filled.select(*own, *(_arriving(F.col(c), ch.lag, zero(c)).alias(c) for c, (ch, _) in made.items()))
    if "comment_score" in made and "has_comment" not in made:
        done = done.withColumn("has_comment", F.col("comment_score").isNotNull())
    if "lhb_present" in made:
        done = done.withColumn("lhb_count_5d", F.sum("lhb_present").over(last_rows(5)).cast("int"))
    return done


def scrubbed(columns: list[str], off: tuple[str, ...] = (), topics: bool = False) -> list[str]:
    """The columns a feature scan reads: no ``*_lag<n>``, no ``topic_*`` unless asked for, none of the channels in ``off``."""
    gone = {c for ch in CHANNELS if ch.name in off for c in ch.columns}
    prefixes = tuple(f"{name}_" for name in off)
    return [c for c in columns if not re.search(r"_lag\d+$", c) and (topics or not c.startswith("topic_")) and c not in gone and not (prefixes and c.startswith(prefixes))]


def save_features(features: DataFrame, path: str) -> None:
    """Features as Parquet, sorted by entity and date in each file, so that a scan of an entity skips row groups."""
    features.repartition(ENTITY).sortWithinPartitions(ENTITY, DATE).write.mode("errorifexists").parquet(path)


def load_features(spark, path: str, off: tuple[str, ...] = (), topics: bool = False) -> DataFrame:
    """The stored features without scrubbed columns; the scan reads only the others."""
    stored = spark.read.parquet(path)
    return stored.select(*scrubbed(stored.columns, off, topics))


def sector_broadcast(rows: DataFrame, sectors: DataFrame, key: str = "sector_code") -> DataFrame:
    """A panel by (date, sector) on every row of its sector; before its coverage strength, breadth and alpha are 0.

    With the columns of the rotation graph also its quadrant: 2 for x above 0, plus 1 for y above 0; NULL counts as not above.
    """
    out = rows.join(sectors, [DATE, key], "left")
    zeroed = [c for c in ("sector_relative_strength", "sector_breadth_z", "sector_alpha") if c in sectors.columns]
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zeroed})
    if {"sector_rrg_x", "sector_rrg_y"} <= set(sectors.columns):
        above = lambda c: F.coalesce(F.col(c) > 0, F.lit(False)).cast("int")
        out = out.withColumn("sector_rrg_quadrant", above("sector_rrg_x") * 2 + above("sector_rrg_y"))
    return out


def first_of(rows: DataFrame, meta: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row of ``meta`` by ``order`` for each (entity, date), joined to ``rows``."""
    first = meta.groupBy(ENTITY, DATE).agg(F.min(F.struct(*order, F.struct(*columns).alias("_row")))["_row"].alias("_row"))
    return rows.join(first.select(ENTITY, DATE, "_row.*"), [ENTITY, DATE], "left")


def leaders(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The entity with the largest ``value`` in each group; of ties the smallest; NULL values never lead."""
    best = F.min_by(ENTITY, F.struct(-F.col(value), F.col(ENTITY)))
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("leader"), F.max(value).alias(value))
