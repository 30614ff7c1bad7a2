"""Contracts of tables: codes, keys, dates, units, price order, identities; and reports of what breaks them.

A contract is a list of named conditions that a bad row meets. ``report`` counts all of them in one
aggregate over one scan and turns the row into a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, before, col


def normal_code(x: Column | str) -> Column:
    """Six digits from forms such as SH600001, 600001.SH, 600001.0 or 1; NULL if it is none or its market disagrees."""
    raw = F.upper(F.trim(col(x).cast("string")))
    bare = F.regexp_replace(raw, r"\.0+$", "")
    said = F.coalesce(F.nullif(F.regexp_extract(bare, r"^(SH|SZ|BJ)[0-9]{6}$", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"^[0-9]{6}\.(SH|SZ|BJ)$", 1), F.lit("")))
    digits = F.regexp_extract(bare, r"^(?:SH|SZ|BJ)?([0-9]{1,6})(?:\.(?:SH|SZ|BJ))?$", 1)
    code = F.when(digits != "", F.lpad(digits, 6, "0"))
    return F.when(said.isNull() | (said == F.coalesce(market(code), F.lit("?"))), code)


def market(code: Column | str) -> Column:
    """SH, SZ or BJ by a code's first digits."""
    c = col(code)
    return F.when(c.startswith("6"), "SH").when(c.startswith("0") | c.startswith("3"), "SZ").when(c.startswith("4") | c.startswith("8") | c.startswith("92"), "BJ")


def is_equity(code: Column | str) -> Column:
    return F.coalesce(col(code).rlike(r"^(60[0135]|68[89]|00[0123]|30[012]|43|83|87|88|92)"), F.lit(False))


def board(code: Column | str) -> Column:
    c = col(code)
    return F.when(c.startswith("60"), 1).when(c.startswith("68"), 2).when(c.startswith("00"), 3).when(c.startswith("30"), 4).when(c.startswith("8") | c.startswith("4"), 5).otherwise(0)


def finite(x: Column | str) -> Column:
    v = col(x).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def bar_rules(tolerance: float = 1e-9, gap: float = 0.5) -> dict[str, Column]:
    """Conditions of a bad bar; needs ``pct_change`` for the identity."""
    prices = ("open", "high", "low", "close")
    vwap = F.try_divide(F.col("amount"), F.col("volume"))
    return {
        "null_key": F.col(ENTITY).isNull() | F.col(DATE).isNull(),
        "weekend": F.weekday(DATE) >= 5,
        "price_not_positive": F.least(*(F.col(p) for p in prices)) <= 0,
        "negative_volume": (F.col("volume") < 0) | (F.col("amount") < 0),
        "not_finite": ~finite("close"),
        "below_low": F.least(F.col("open"), F.col("close")) < F.col("low") - tolerance,
        "above_high": F.greatest(F.col("open"), F.col("close")) > F.col("high") + tolerance,
        "pct_identity": F.abs(F.col("pct_change") - (F.try_divide(F.col("close"), before("close")) - 1) * 100) > gap,
        "amount_without_volume": (F.col("volume") == 0) & (F.col("amount") > 0),
        "volume_without_amount": (F.col("volume") > 0) & (F.col("amount") == 0),
        "vwap_out_of_band": (vwap < F.col("close") / 100) | (vwap > F.col("close") * 100),
    }


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and rows that break it; rules with window expressions are evaluated before the one aggregate."""
    marked = df.select(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items()))
    counts = marked.agg(*(F.count_if(F.col(k)).alias(k) for k in rules))
    return counts.unpivot([], list(rules), "rule", "violations")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    by = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.count("*").alias("keys"))


def off_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    return df.join(calendar.select(DATE), DATE, "left_anti")


def finite_share(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(finite(c).cast("double")).alias(c) for c in columns)).unpivot([], columns, "feature", "share")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def repaired_change(df: DataFrame) -> DataFrame:
    """pct_change recomputed where it is NULL or 0."""
    own = (F.try_divide(F.col("close"), before("close")) - 1) * 100
    return df.withColumn("pct_change", F.when(F.col("pct_change").isNull() | (F.col("pct_change") == 0), own).otherwise(F.col("pct_change")))


def alignment(aux: DataFrame, bars: DataFrame, x: str, limit: float) -> DataFrame:
    """Per entity: days in both tables, greatest difference of ``x``, and whether it stays in the limit."""
    both = aux.select(ENTITY, DATE, F.col(x).alias("_a")).join(bars.select(ENTITY, DATE, F.col(x).alias("_b")), [ENTITY, DATE])
    return both.groupBy(ENTITY).agg(F.count("*").alias("days"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("worst")).withColumn("ok", F.col("worst") <= limit)


def reconciled(wanted: DataFrame, there: DataFrame, key: str = ENTITY) -> DataFrame:
    """Every key of either side: present, missing or unasked."""
    a, b = wanted.select(key, F.lit(True).alias("_w")).distinct(), there.select(key, F.lit(True).alias("_t")).distinct()
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_w") & F.col("_t"), "present").when(F.col("_w"), "missing").otherwise("unasked").alias("status"))


def microstructure(limit: float = 0.098) -> dict[str, Column]:
    r = F.try_divide(F.col("close"), before("close")) - 1
    up = r >= limit
    one = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return {
        "limit_up": up, "limit_down": r <= -limit, "gap_up": F.col("low") > before("high"), "gap_down": F.col("high") < before("low"), "one_word": one & up,
        "seal": F.when(up, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("close"), F.col("high"))))).otherwise(0.0),
    }


def trend_class(c: str, m5: str, m10: str, m20: str, m60: str) -> Column:
    """Seven levels by the order of close and means; missing means leave the middle one."""
    gt = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    lt = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(False))
    return (
        F.when(gt(c, m5) & gt(m5, m10) & gt(m10, m20) & gt(m20, m60), 6).when(gt(c, m5) & gt(m5, m10) & gt(m10, m20), 5).when(gt(c, m5) & gt(m5, m10), 4)
        .when(lt(c, m5) & lt(m5, m10) & lt(m10, m20) & lt(m20, m60), 0).when(lt(c, m5) & lt(m5, m10) & lt(m10, m20), 1).when(lt(c, m5) & lt(m5, m10), 2).otherwise(3)
    )


def volume_class(ratio: Column | str) -> Column:
    return F.when(col(ratio) < 0.7, "shrink").when(col(ratio) > 1.5, "heavy").otherwise("normal")


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value, from one aggregate of minima and maxima."""
    row = df.agg(*(F.min(c).alias(f"a_{c}") for c in columns), *(F.max(c).alias(f"b_{c}") for c in columns)).first()
    return [c for c in columns if row[f"a_{c}"] != row[f"b_{c}"]]


def flat_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: share of entities on which it never moves; 0.9 or more makes it dead."""
    by = df.groupBy(ENTITY).agg(*((F.min(c) == F.max(c)).cast("double").alias(c) for c in columns))
    return by.agg(*(F.avg(F.coalesce(c, F.lit(1.0))).alias(c) for c in columns)).unpivot([], columns, "feature", "share").withColumn("dead", F.col("share") >= 0.9)


def structural_quality(df: DataFrame, r: str, deviation: float = 0.5) -> DataFrame:
    """Per entity: the reason to leave it out of training, NULL if there is none."""
    w = Window.partitionBy(ENTITY).orderBy(DATE)
    fwd = F.try_divide(F.lead("close", 5).over(w), F.col("close")) - 1
    by = df.withColumn("_f", fwd).groupBy(ENTITY).agg(F.count(r).alias("n"), F.stddev_samp(r).alias("s"), F.max(F.abs("_f")).alias("f"))
    return by.select(ENTITY, F.when(F.col("n") == 0, "all missing").when(F.col("s") > deviation, "too volatile").when(F.col("f") > 10, "outlier").alias("reason"))
