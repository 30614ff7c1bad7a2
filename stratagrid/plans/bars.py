"""The bar table that the panel queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.operators.bars import bars
from stratagrid.plans.registry import query
from stratagrid.plans.sql import BARS
from stratagrid.session import table


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "lineitem"))


@query("sc01_bars", f"SELECT entity, date, open, high, low, close, volume, round(amount, 4) AS amount FROM ({BARS})")
def bars_query(spark, sf_dir):
    return daily(spark, sf_dir).withColumn("amount", F.round("amount", 4))
