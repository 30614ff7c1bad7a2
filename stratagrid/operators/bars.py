"""Daily bars per entity, built from the line items of each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(lineitem: DataFrame) -> DataFrame:
    """One row per (entity, date): unit price open/high/low/close, volume and amount.

    Open and close follow (order key, line number). One shuffle, with map-side aggregation.
    """
    price = F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))
    turn = F.struct("l_orderkey", "l_linenumber", price.alias("p"))
    return (
        lineitem.withColumn("price", price)
        .groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.min(turn)["p"].alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max(turn)["p"].alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
    )
