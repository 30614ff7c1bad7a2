"""Text operators: cleaning, noise, sentiment by lexicon, decay, session alignment, daily and topic statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType
from pyspark.sql.window import Window

from stratagrid.functions import edits
from stratagrid.functions.windows import DATE, ENTITY, col
from stratagrid.session import dropped, stored

POSITIVE = ("the", "tion", "est")
NEGATIVE = ("idiot", "worthless", "moron", "scum", "trash")


def clean(x: Column | str) -> Column:
    """Markup removed, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(x), "<[^>]*>", " "), r"\s+", " "))


def is_noise(x: Column | str, least: int = 5) -> Column:
    """Too short, or without a letter or digit of any script."""
    return (F.length(col(x)) < least) | ~col(x).rlike(r"[\p{L}\p{N}]")


def lexicon_score(x: Column | str, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) over the different terms that occur; 0 if none does."""
    hits = lambda words: sum((F.contains(F.lower(col(x)), F.lit(w)).cast("double") for w in words), F.lit(0.0))
    p, n = hits(positive), hits(negative)
    return F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0))


def bipolar(x: Column | str, edge: float = 0.2) -> Column:
    v = col(x)
    return F.when(v > edge, "bull").when(v < -edge, "bear").when(v.isNotNull(), "neutral")


def decay_weight(df: DataFrame, at: str = DATE, half_life: float = 7.0) -> Column:
    """exp(-ln 2 / half_life * age in days against the table's last date)."""
    last = df.agg(F.max(at).alias("d"))
    return F.exp(-math.log(2) / half_life * F.greatest(F.date_diff(last.scalar(), at), F.lit(0)))


def aligned(posts: DataFrame, calendar: DataFrame, ts: str = "ts", close_s: int = 15 * 3600) -> DataFrame:
    """``aligned_date``: the post's own day, or the next session if it came after the close.

    The next session of each day is looked up in a table of one row a day.
    """
    after = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) > close_s
    days = posts.select(F.to_date(ts).alias("_day")).distinct()
    both = days.select("_day", F.lit(None).cast("date").alias("_s")).unionByName(calendar.select(F.col(DATE).alias("_day"), F.col(DATE).alias("_s")))
    following = F.min("_s").over(Window.orderBy("_n").rangeBetween(1, Window.unboundedFollowing))  # a row or two a day
    lookup = both.withColumn("_n", F.unix_date("_day")).withColumn("_next", following).where("_s is null").select(F.col("_day").alias("_d"), "_next")
    return posts.join(lookup, F.to_date(ts) == F.col("_d"), "left").withColumn("aligned_date", F.when(after, F.coalesce("_next", F.to_date(ts))).otherwise(F.to_date(ts))).drop("_d", "_next")


def daily_stats(posts: DataFrame, score: str, weight: str | None = None, edge: float = 0.2) -> DataFrame:
    """Per (entity, date): counts and shares by sentiment, bipolarity, agreement, attention, moments, divergence, decayed mean."""
    v = F.col(score)
    n, bull, bear = F.count(v), F.count_if(v > edge), F.count_if(v < -edge)
    dev = F.coalesce(F.stddev_pop(v), F.lit(0.0))
    out = posts.groupBy(ENTITY, DATE).agg(
        n.alias("n"), bull.alias("bull"), bear.alias("bear"), (n - bull - bear).alias("neutral"), ((bull - bear) / (bull + bear + 1)).alias("bipolar"), F.greatest(F.lit(0.0), 1 - dev).alias("agreement"), F.log1p(n.cast("double")).alias("attention"),
        F.try_divide(bull.cast("double"), n.cast("double")).alias("bull_ratio"), F.avg(v).alias("mean"), dev.alias("std"), F.when((n >= 3) & (dev >= 1e-10), F.skewness(v)).otherwise(0.0).alias("skew"), (dev / (F.abs(F.avg(v)) + 0.05)).alias("divergence"),
        *([(F.sum(v * F.col(weight)) / F.sum(weight)).alias("decayed_mean")] if weight else []),
    )
    return out


def topic_stats(posts: DataFrame, topic: str, score: str) -> DataFrame:
    """Per (entity, date): topics, entropy, the dominant one (smallest of the most frequent), deviation of topic means."""
    by = posts.groupBy(ENTITY, DATE, topic).agg(F.count("*").alias("c"), F.avg(score).alias("m"))
    w = Window.partitionBy(ENTITY, DATE)
    p = F.col("c") / F.sum("c").over(w)
    return by.withColumn("p", p).groupBy(ENTITY, DATE).agg(
        F.count("*").alias("topics"), F.when(F.count("*") > 1, -F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).otherwise(0.0).alias("entropy"), F.max(F.struct("c", (-F.col(topic)).alias("t")))["t"].alias("_t"), F.coalesce(F.stddev_pop("m"), F.lit(0.0)).alias("spread"),
    ).withColumn("dominant", -F.col("_t")).drop("_t")


def best_posts(posts: DataFrame, keys: list[str], body: str, tie: str) -> DataFrame:
    """One post per key: with a body before without, the longest, then the smallest ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col(body).isNotNull() & (F.length(body) > 0)), F.desc(F.coalesce(F.length(body), F.lit(0))), tie)
    return posts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: Runs of so many characters are counted.
RUN = 3


@F.pandas_udf(BinaryType())
def run_counts(texts: pd.Series) -> pd.Series:
    """A text's runs of RUN characters, as often as they occur."""
    return texts.map(lambda t: edits.runs(edits.code_points(t), RUN).tobytes())


@F.pandas_udf(DoubleType())
def least_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many edits it takes at least to turn one text's counts into the other's."""
    return pd.Series([edits.least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), RUN) for x, y in zip(a, b, strict=True)], dtype=float)


#: Characters of a block of posts, about; a larger one is compared part by part. And pairs that it hands on at once.
PART = 1 << 23
PAIRS = 1 << 16


def compared(days: int, least: float) -> Callable:
    """Of one block, or two parts of one: pairs of posts that are alike, and the edits between them."""

    def found(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, band, one, two = (k.as_py() for k in key[1:])
        rows = pa.Table.from_batches(list(batches)).sort_by("size").combine_chunks()
        texts = rows["t"].to_pylist()
        n, own, of, part = (rows[c].to_numpy() for c in ("n", "cell0", "band0", "part"))

        def wanted(i: int, at: slice) -> np.ndarray:
            # two posts that came for shorter or earlier ones only meet elsewhere
            ok = (of[i] == band) & (np.abs(n[at] - n[i]) <= days) & ((own[at] == cell) | (own[i] == cell))
            return ok & (part[at] != part[i]) if one != two else ok

        def batch(pairs: list) -> pa.RecordBatch:
            a, b, apart = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
            taken = [rows[c].combine_chunks().take(at) for c in ("k", "d") for at in (a, b)]
            return pa.RecordBatch.from_arrays([*taken, apart, rows["size"].combine_chunks().take(b)], ["k", "k0", "d", "d0", "edits", "longer"])

        held = []
        for i, j in edits.close(texts, 1 - least, wanted):
            held.append((i, j, edits.distance(texts[i], texts[j])))
            if len(held) >= PAIRS:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    return found


def near_pairs(posts: DataFrame, text: str, key: str, days: int = 3, least: float = 0.9) -> DataFrame:
    """Posts that repeat an earlier one of at most ``days`` before, by edit similarity of their whole texts, in lower case.

    Similarity is 1 - edit distance / longer length, so texts whose lengths are not within ``least`` of
    each other can't be alike. A block holds an entity's posts of 2 ``days`` and a band of lengths, and those that may be alike to one
    of them though their own block is the next: each pair meets once, in the block of the earlier day and the shorter text.
    There sets of their runs of characters say how many edits it takes at least (``functions.edits``), which leaves out unlike pairs at a few
    hundred operations each and loses none; only the others are compared. Blocks of more than PART characters are dealt to parts, and each pair of parts is a group.
    """
    span, width = max(1, 2 * days), -3 * math.log(least)
    band = lambda size: F.floor(F.log(size) / width)
    p = posts.select(ENTITY, F.col(DATE).alias("d"), F.col(key).alias("k"), F.lower(text).alias("t")).where((F.length("t") > 0) & F.col(ENTITY).isNotNull() & F.col("d").isNotNull())
    p = p.withColumns({"n": F.unix_date("d"), "size": F.length("t")})
    p = p.withColumns({"cell0": F.floor(F.col("n") / span), "band0": band(F.col("size").cast("double"))})
    p = p.withColumn("cell", F.explode(F.array_distinct(F.array("cell0", F.floor((F.col("n") - days) / span)))))
    p = p.withColumn("band", F.explode(F.array_distinct(F.array("band0", band(F.greatest(F.col("size") * least - 1e-6, F.lit(1.0)))))))
    block = [ENTITY, "cell", "band"]
    large = p.groupBy(*block).agg(F.ceil(F.sum("size") / PART).alias("parts")).where("parts > 1")  # a row for each PART characters at most
    p = p.join(F.broadcast(large), block, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    p = p.withColumn("part", F.pmod(F.xxhash64("k", "d", "t"), "parts")).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    p = p.withColumns({"one": F.least("part", "_o"), "two": F.greatest("part", "_o")}).drop("_o", "parts")
    kinds = dict(p.dtypes)
    both = p.groupBy(*block, "one", "two").applyInArrow(compared(days, least), f"k {kinds['k']}, k0 {kinds['k']}, d {kinds['d']}, d0 {kinds['d']}, edits int, longer int")
    behind = (F.col("d0") < F.col("d")) | ((F.col("d0") == F.col("d")) & (F.col("k0") < F.col("k")))
    ahead = (F.col("d") < F.col("d0")) | ((F.col("d") == F.col("d0")) & (F.col("k") < F.col("k0")))
    alike = F.round(1 - F.col("edits") / F.col("longer"), 6)
    pairs = both.where(behind | ahead).select(F.when(behind, F.col("k")).otherwise(F.col("k0")).alias("later"), F.when(behind, F.col("k0")).otherwise(F.col("k")).alias("earlier"), alike.alias("similarity"))
    return pairs.where(F.col("similarity") > least).distinct()


def first_of_equals(posts: DataFrame, text: str, key: str) -> DataFrame:
    """``posts`` with ``first``: the smallest key of an entity's equal texts (in lower case) of one day.

    What drops the first drops the others, and if it stays they fall by it; so only firsts need comparing.
    """
    same = posts.groupBy(F.col(ENTITY).alias("_e"), F.col(DATE).alias("_d"), F.xxhash64(F.lower(text)).alias("_h"), F.lower(text).alias("_t")).agg(F.min(key).alias("first"))
    on = (F.col(ENTITY) == F.col("_e")) & (F.col(DATE) == F.col("_d")) & (F.xxhash64(F.lower(text)) == F.col("_h")) & (F.lower(text) == F.col("_t"))
    return posts.join(same, on).drop("_e", "_d", "_h", "_t")


def decided(pairs: DataFrame) -> DataFrame:
    """Of the posts in ``pairs`` of later and earlier: ``k`` and ``kept``, as if posts were taken one by one in order.

    A post falls by an earlier one that stays, not by one that fell itself. Each round decides the posts
    of which some earlier neighbour stays, or of which all are decided: the first in order is always among
    these, so rounds are as many as the longest alternation, and what is left is written between them.
    """
    left, found = stored(pairs.select(F.col("later").alias("a"), F.col("earlier").alias("b")).distinct()), None
    nodes = left.select(F.col("a").alias("k")).unionByName(left.select(F.col("b").alias("k"))).distinct()
    open_ = stored(nodes)
    while not open_.isEmpty():
        waiting = left.select(F.col("a").alias("k")).distinct()
        stays = open_.join(waiting, "k", "left_anti")  # no earlier neighbour is left
        falls = left.join(stays.withColumnRenamed("k", "b"), "b", "left_semi").select(F.col("a").alias("k")).distinct()
        done = stored(stays.withColumn("kept", F.lit(True)).unionByName(falls.withColumn("kept", F.lit(False))))
        rest = stored(open_.join(done, "k", "left_anti"))
        gone = done.select("k")
        edges_left = stored(left.join(gone.withColumnRenamed("k", "a"), "a", "left_anti").join(gone.withColumnRenamed("k", "b"), "b", "left_anti"))
        dropped(open_, left)
        open_, left = rest, edges_left
        found = done if found is None else found.unionByName(done)
    dropped(open_, left)
    return pairs.select(F.col("later").alias("k")).limit(0).withColumn("kept", F.lit(True)) if found is None else found


def without_near_copies(posts: DataFrame, text: str, key: str, days: int = 3, least: float = 0.9) -> DataFrame:
    """``posts`` with ``kept``: false for one that repeats a kept earlier one of at most ``days`` before.

    Order is by date, then key. Posts without an entity, a date or a text are kept; a repeated key is one post.
    """
    first = F.col("first") == F.col(key)
    held = first_of_equals(posts.where(F.col(ENTITY).isNotNull() & F.col(DATE).isNotNull() & (F.length(text) > 0)).dropDuplicates([key]), text, key)
    held = stored(held.select(ENTITY, DATE, key, F.when(first, F.col(text)).alias(text), "first"))  # read by every step below; texts of firsts only
    verdict = decided(near_pairs(held.where(first).select(ENTITY, DATE, key, text), text, key, days, least)).select(F.col("k").alias("_k"), F.col("kept").alias("_kept"))
    fallen = stored(verdict.where("not _kept").select(F.col("_k").alias(key)).unionByName(held.where(F.col("first") < F.col(key)).select(key)).distinct()).withColumn("kept", F.lit(False))
    dropped(held)
    return posts.join(fallen, key, "left").withColumn("kept", F.coalesce("kept", F.lit(True)))


def statutory_date(period: Column | str) -> Column:
    """Last disclosure day of a report period: Q1 and year by 30 April, half by 31 August, Q3 by 31 October."""
    d = col(period)
    y, m = F.year(d), F.month(d)
    return F.when(m <= 3, F.make_date(y, F.lit(4), F.lit(30))).when(m <= 6, F.make_date(y, F.lit(8), F.lit(31))).when(m <= 9, F.make_date(y, F.lit(10), F.lit(31))).otherwise(F.make_date(y + 1, F.lit(4), F.lit(30)))


def calendar_parts(d: Column | str) -> dict[str, Column]:
    return {"dow": F.weekday(col(d)), "day": F.day(col(d)), "month": F.month(col(d)), "quarter": F.quarter(col(d))}


def sanitised(x: Column | str, edge: float = 10.0) -> Column:
    """0 for NULL, NaN and infinities; otherwise held within the edges."""
    v = col(x).cast("double")
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(-edge), F.least(F.lit(edge), v)))
