"""Corrupted copies of a panel for tests of robustness, the same after a retry and however rows are dealt out.

Every random number is a hash of the seed and of what it is for: the row's keys and the column for noise, a
fixed word for the time mask, the column for dropout. So there is no generator whose state a lost task
would lose, and the copy is one narrow pass over the rows.

* noise: normal, independent for each cell, on observed rows only;
* time mask: with some probability one run of up to five sessions is 0 for every entity;
* dropout: each column is 0 throughout with some probability.

Defined results: null stays null but where a mask makes it 0; fewer than three sessions are never masked; an
unknown observation is none; rows without a date are never masked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY, col

#: Hex digits of a hash that make a number; 16^13 is exact in a double.
DIGITS = 13
LONGEST = 5


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in (0, 1) from the seed and the values of columns, as text joined by ``|``."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(col(w).cast("string"), F.lit("")) for w in what))
    digits = F.substring(F.md5(text.cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def normal(seed: int, *what: Column | str) -> Column:
    """A standard normal number, by the polar angle of two uniform ones."""
    a, b = uniform(seed, F.lit("a"), *what), uniform(seed, F.lit("b"), *what)
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * math.pi * b)


def masked_dates(calendar: DataFrame, seed: int, mask: float) -> DataFrame:
    """The sessions of the time mask: none, or one run of 1 to LONGEST of them (less than half of all and one)."""
    dates = calendar.select(DATE).where(F.col(DATE).isNotNull()).distinct()
    order = dates.select(DATE, (F.row_number().over(Window.orderBy(DATE)) - 1).alias("i"))  # a row a date
    draw = lambda what, n: F.floor(uniform(seed, F.lit(what)) * n)
    n = dates.agg(F.count("*").alias("n"))
    length = 1 + draw("length", F.least(F.lit(LONGEST), F.floor(F.col("n") / 2)))
    run = n.select("n", length.alias("length")).withColumn("start", draw("start", F.col("n") - F.col("length")))
    run = run.where((F.col("n") >= 3) & (uniform(seed, F.lit("mask")) < mask))
    return run.withColumn("i", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1))).join(order, "i").select(DATE)


def corrupted(df: DataFrame, columns: list[str], seed: int, observed: Column | None = None, noise: float = 0.01, mask: float = 0.05, dropout: float = 0.02) -> DataFrame:
    """``df`` with the named columns corrupted; all else stays."""
    hidden = masked_dates(df, seed, mask).agg(F.collect_list(DATE).alias("d"))  # LONGEST dates
    seen = F.lit(True) if observed is None else F.coalesce(observed, F.lit(False))
    df = df.withColumn("_hidden", hidden.scalar())
    out = {}
    for c in columns:
        value = F.when(seen, F.col(c) + F.lit(noise) * normal(seed, F.lit(c), ENTITY, DATE)).otherwise(F.col(c).cast("double")) if noise > 0 else F.col(c).cast("double")
        off = F.coalesce(F.array_contains("_hidden", F.col(DATE)), F.lit(False)) | (uniform(seed, F.lit("dropout"), F.lit(c)) < dropout)
        out[c] = F.when(off, 0.0).otherwise(value)
    return df.withColumns(out).drop("_hidden")
