"""Roles of stored features: which of them a model may know ahead of a day, and which only after it.

A catalog is a row a feature: its name, role and place. It is stored beside the features, and scans are
planned from it: a scan by role names its columns, so the reader opens no others.

Roles: ``key`` (entity, date), ``meta`` (sector and size, for grouping), ``withheld`` (price levels, which
change when a later split re-bases them), ``past_known`` and ``past_observed``, which is all that is left. The
names that scans always leave out, such as lags and topics, have no row.

Defined results: a name in no list is ``past_observed``; a role without features gives the keys alone; features
that were written after the catalog aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions.windows import DATE, ENTITY
from stratagrid.operators.catalog import scrubbed

SCHEMA = "feature string, role string, place int"
META = ("sector", "size_proxy", "sector_code")
#: Fixed: the price levels themselves, by their whole names.
WITHHELD = ("open", "high", "low", "close")
#: A feature whose name begins with one of these is known ahead.
KNOWN_BY = (
    "open", "high", "low", "close", "volume", "amount",
    "ma_", "ema_", "macd_", "rsi_", "kdj_", "boll_", "atr_", "roc_", "wr_", "cci_", "vol_", "volume_", "amount_",
    "kmid", "klen", "kup", "klow", "ksft", "open0", "high0", "low0", "adx", "adxr", "pdi", "mdi", "mfi_", "cmo_", "trix", "obv", "turnover",
    "is_limit_", "gap_", "volume_anomaly", "limit_up_", "is_one_word", "seal_quality",
    "day_of_", "month", "quarter", "minutes_", "is_am_", "is_pm_", "session_", "bar_of_", "opening_", "session_high",
    "trend_level", "bias_", "buy_signal", "pct_change",
    "max_", "min_", "qtlu_", "qtld_", "rank_", "rsv_", "corr_", "cord_", "beta_", "rsqr_", "resi_", "vma_", "vstd_",
    "cntp_", "cntn_", "cntd_", "sump_", "sumn_", "sumd_", "imax_", "imin_", "imxd_", "wvma_", "vsump_", "vsumn_", "vsumd_", "interaction_",
    "roe", "roa", "eps", "revenue_yoy", "profit_yoy", "debt_ratio", "gross_margin", "net_margin", "pe_ttm", "pb_mrq", "ps_ttm", "pcf_ttm",
    "f_score", "quality_composite", "earnings_quality", "profitability_stability", "margin_stability", "growth_quality",
    "pe_percentile_", "pb_percentile_", "pe_pb_divergence", "deep_value", "roe_trend_", "revenue_trend_", "margin_trend_", "roe_accel", "earnings_surprise",
    "pe_sector_ratio", "pb_sector_ratio", "ps_sector_ratio", "leverage_warning", "valuation_composite_z",
)


def role(name: str) -> str:
    if name in (ENTITY, DATE):
        return "key"
    if name in META:
        return "meta"
    if name in WITHHELD:
        return "withheld"
    return "past_known" if name.startswith(KNOWN_BY) else "past_observed"


def catalog(features: DataFrame, off: tuple[str, ...] = (), topics: bool = False) -> DataFrame:
    """feature, role and place of the columns that scans may read."""
    rows = [(c, role(c), i) for i, c in enumerate(scrubbed(features.columns, off, topics))]
    return features.sparkSession.createDataFrame(rows, SCHEMA)


def save(features: DataFrame, path: str, off: tuple[str, ...] = (), topics: bool = False) -> None:
    """Features by entity and date, and their catalog, which is written last: without it nothing is read."""
    features.repartition(ENTITY).sortWithinPartitions(ENTITY, DATE).write.mode("errorifexists").parquet(f"{path}/features")
    catalog(features, off, topics).coalesce(1).write.mode("errorifexists").parquet(f"{path}/catalog")


def listed(spark: SparkSession, path: str, *roles: str) -> list[str]:
    """Names of the features of these roles, in the order they were written; a row a feature reaches the driver."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/catalog").where(F.col("role").isin(*roles)).orderBy("place")
    return [r["feature"] for r in rows.select("feature").collect()]


def scan(spark: SparkSession, path: str, *roles: str, start: str | None = None, end: str | None = None, entities: list | None = None) -> DataFrame:
    """Keys and the features of these roles, of a range of dates and some entities; ranges and names reach the reader."""
    df = spark.read.parquet(f"{path}/features")
    if start is not None:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(DATE) <= F.lit(end).cast("date"))
    if entities is not None:
        df = df.where(F.col(ENTITY).isin(entities))
    return df.select(ENTITY, DATE, *listed(spark, path, *roles))
