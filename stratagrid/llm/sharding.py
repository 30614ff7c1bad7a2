"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Each source partition orders its rows by a seeded hash (a local permutation) and numbers them.
2. From the partitions' row counts and the wanted shard sizes the matrix "rows of partition i that go
   to shard j" is drawn, each row of it from the multivariate hypergeometric distribution given the
   rows before. That is a plan of at most MAX_SOURCES x shards counts, whatever the table's size.
3. Row number ``pos`` of partition i goes to the shard in whose run of counts it falls.
4. Each shard orders its rows by a second hash: shards are cut in buckets by that hash, buckets are
   counted and numbered on their own, and a bucket's slots start behind those before it. So no task
   holds a whole shard.

All rows move through DataFrame operations; only the counts of step 2 reach the driver. The numbered
rows are cut to the shared folder, so a task that runs again sees the same numbers.

Defined results: shard sizes differ by at most one (law ``rows``); a null text has size 8 and the
checksum of no bytes; repeated rows are rows like others; ids may be null; an empty table gives an
empty table; input columns that clash with result columns are replaced in ``shuffled``.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.session import cut

#: Source partitions, at most; a plan has this many rows.
MAX_SOURCES = 4096
#: Deviations from the mode within which a draw is looked for.
REACH = 12
#: Rows that a task of the second permutation numbers, about.
BUCKET_ROWS = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from ``good`` + ``bad``, by inversion.

    Probabilities are taken relative to the mode's, by the ratios of neighbours, and divided by their
    own sum, so no large logarithms are subtracted; what lies REACH deviations away is below 1e-30.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    width = int(REACH * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))) + REACH
    up = np.arange(mode, min(high, mode + width), dtype=np.float64)
    down = np.arange(mode, max(low, mode - width), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    upto = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(down) + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(upto) - 1)


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each source sends to each shard: row sums are ``counts``, column sums at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    sent = []
    for n in counts:
        left, others, row = n, sum(room), []
        for j in range(shards):
            others -= room[j]
            k = hypergeometric(rng, room[j], others, left)
            row.append(k)
            left -= k
        room = [a - b for a, b in zip(room, row, strict=True)]
        sent.append(row)
    return sent


def assigned(rows: DataFrame, identity: list[str], shards: int, seed: int) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``identity`` are the columns that the hashes are taken of."""
    numbered = (
        rows.coalesce(MAX_SOURCES)
        .withColumn("_r1", F.xxhash64(F.lit(seed), *identity, F.monotonically_increasing_id()))
        .withColumn("_r2", F.xxhash64(F.lit(seed + 1), "_r1", *identity))
        .sortWithinPartitions("_r1", *identity)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    numbered = cut(numbered.withColumn("_source", F.shiftright("_at", 33).cast("int")).withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_r1"))
    counts = {r["_source"]: r["n"] for r in numbered.groupBy("_source").agg(F.count("*").alias("n")).collect()}  # at most MAX_SOURCES rows
    total, sources = sum(counts.values()), sorted(counts)
    plan = []
    for source, row in zip(sources, matrix([counts[s] for s in sources], shards, seed), strict=True):
        ends, end = [], 0
        for k in row:
            end += k
            ends.append(end)
        plan.append({"_of": source, "_ends": ends})
    spark = rows.sparkSession
    drawn = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), "array<struct<_of:int,_ends:array<bigint>>>")))
    sent = numbered.join(F.broadcast(drawn), F.col("_source") == F.col("_of"))  # bounded by MAX_SOURCES
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_pos"))).cast("int"))
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    sent = sent.withColumn("_bucket", F.pmod(F.shiftright("_r2", 20), F.lit(buckets)).cast("int")).drop("_of", "_ends", "_source", "_pos")
    sizes = sent.groupBy(F.col("shard").alias("_s"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("shard", "_bucket").orderBy("_r2", *identity)
    placed = sent.withColumn("_own", F.row_number().over(own)).join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return placed.withColumn("slot", (F.col("_from") + F.col("_own") - 1).cast("long")).drop("_s", "_b", "_from", "_own", "_r2", "_bucket")


def measured(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20240101) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    rows = assigned(measured(docs), ["doc_id", "text_crc32", "size"], shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shuffled(docs: DataFrame, shards: int = 24, seed: int = 20240101) -> DataFrame:
    """The documents themselves with ``shard`` and ``slot``."""
    rows = docs.drop("shard", "slot")
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), "doc_id", F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("crc"))
    return assigned(held, ["doc_id", "crc"], shards, seed).select("row.*", "shard", "slot")
