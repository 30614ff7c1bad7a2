"""Benchmark decontamination by spaced seeds.

A seed is a run of SPAN words of which a fixed mask looks at some: two runs that differ only where
the mask is blind have the same seed. Of an overlap of REACH words with any SPARE of them substituted,
at least one mask has a seed at some start that looks at none of these (a test goes through all
placements). Seeds of the benchmark and of the documents are joined, and around each hit the two texts
are compared word by word on the hit's diagonal: REACH words of which at most SPARE differ (a shorter
item: nearly all its words) make an overlap.

Documents only send seeds that a bitmap of the benchmark's seeds holds; its size is fixed (BITS), so
it can be broadcast whatever the benchmark's size, and a false bit only costs a row that the join
drops. The join itself is left to Spark. No document's text is shuffled.

Words are lower-cased (A-Z) and freed of ASCII punctuation. Items of up to SPAN words are sought as a
whole, by masks of their length: an unmasked one where no word may differ, else ones that are blind at
some third of the item each. Items of fewer than LEAST words are not sought, as they can't be told
from chance.

Defined results: null and empty texts hold nothing; repeated rows with one id give one row; a null id
is an id of its own; an empty table, or an empty benchmark, gives an empty table; other columns of the
inputs are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import chunks, hash_words, mixed, raw, starts_of

MASKS = ("1110101101", "1101110011", "1011011101", "1111010111", "1100111101")
SPAN = 10
#: Words that are compared, and how many of them may differ.
REACH, SPARE = 13, 2
LEAST = 5
BITS = 25
SIDE = REACH - SPAN
WIDE = SPAN + 2 * SIDE
#: The part of a short item's words that may differ is its length over this.
SHORT = 8
PUNCTUATION = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split()


def whole_masks(n: int) -> list[str]:
    """Masks for items of ``n`` <= SPAN words: each place of a word that may differ is one that some mask is blind to."""
    if n < SHORT:
        return ["1" * n]
    return ["".join("0" if k * n <= 3 * i < (k + 1) * n else "1" for i in range(n)) for k in range(3)]


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed at each start in ``h``: a hash of the words that the mask looks at."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, salt, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mixed(g)


def around(h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, pad: int) -> np.ndarray:
    """32-bit words from SIDE before each ``at`` to SIDE behind the span; ``pad`` where the text has ended."""
    index = at[:, None] - SIDE + np.arange(WIDE)
    inside = (index >= begin[:, None]) & (index < end[:, None])
    short = (h >> np.uint64(32)).astype(np.uint32)
    return np.where(inside, short[np.clip(index, 0, max(0, len(h) - 1))], np.uint32(pad))


def listed(words: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * WIDE), pa.array(words.ravel().view(np.int32)))


def prepared(part: pa.RecordBatch):
    words = [words_of(t) for t in raw(part.column("text"))]
    counts = np.array([len(w) for w in words], np.int64)
    return hash_words([w for ws in words for w in ws]), counts, starts_of(counts), np.repeat(np.arange(len(counts)), counts)


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """seed, item_id, pos, length and surrounding words of each seed of the benchmark."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                h, counts, begin, doc = prepared(part)
                found = []
                for k, mask in enumerate(MASKS):
                    g = seeds(h, mask, k)
                    at = np.flatnonzero(doc[: len(g)] == doc[SPAN - 1 :]) if len(g) else np.zeros(0, np.int64)
                    found.append((g[at], at))
                for n in range(1, SPAN + 1):
                    at = begin[:-1][counts == n]
                    for k, mask in enumerate(whole_masks(n)):
                        g = seeds(h, mask, n * 1000 + k)
                        found.append((g[at], at))
                g, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                if len(g):
                    d = doc[at]
                    words = around(h, at, begin[d], begin[d + 1], 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), part.column("item_id").take(pa.array(d)), pa.array((at - begin[d]).astype(np.int32)), pa.array(counts[d].astype(np.int32)), listed(words)],
                        ["seed", "item_id", "pos", "length", "item_words"],
                    )

    kind = dict(benchmark.dtypes)["item_id"]
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"seed long, item_id {kind}, pos int, length int, item_words array<int>")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key (digest of the text), items, start: one row for each verified place of a document and stretch that ``items`` share."""
    spark = docs.sparkSession
    known = item_seeds(benchmark).groupBy("seed", "pos", "length", "item_words").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    slot = F.shiftrightunsigned("seed", 64 - BITS)
    cells = (
        known.select(slot.alias("slot"), "length")
        .groupBy(F.shiftright("slot", 5).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 31))")).alias("bits"), F.collect_set(F.when(F.col("length") <= SPAN, F.col("length"))).alias("short"))
        .collect()  # at most 2^(BITS - 5) rows
    )
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    for r in cells:
        bitmap[r["cell"]] = r["bits"]
    short = sorted({n for r in cells for n in r["short"]})
    held = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = held.value
        for batch in batches:
            for part in chunks(batch):
                h, counts, begin, doc = prepared(part)
                found = []
                for mask, salt, span in [(m, k, SPAN) for k, m in enumerate(MASKS)] + [(m, n * 1000 + k, n) for n in short for k, m in enumerate(whole_masks(n))]:
                    g = seeds(h, mask, salt)
                    slots = (g >> np.uint64(64 - BITS)).astype(np.int64)
                    at = np.flatnonzero((bits[slots >> 5] >> (slots & 31).astype(np.uint32)) & np.uint32(1))
                    at = at[doc[at] == doc[at + span - 1]]
                    if span < least:  # the whole text only
                        at = at[counts[doc[at]] == span]
                    found.append((g[at], at))
                g, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                if len(g):
                    d = doc[at]
                    words = around(h, at, begin[d], begin[d + 1], 0)
                    take = pa.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.view(np.int64)), part.column("doc_id").take(take), part.column("key").take(take), pa.array((at - begin[d]).astype(np.int64)), listed(words)],
                        ["seed", "doc_id", "key", "start", "doc_words"],
                    )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.col("text").cast("string").alias("text"))
    hits = rows.mapInArrow(run, f"seed long, doc_id {kind}, key binary, start long, doc_words array<int>")

    both = hits.join(known, "seed")
    same = F.zip_with("doc_words", "item_words", lambda a, b: (a == b).cast("int"))
    total = lambda begin, n: F.aggregate(F.slice(F.col("same"), begin, n), F.lit(0), lambda a, v: a + v)
    best = F.greatest(*(total(F.lit(s + 1), F.lit(REACH)) for s in range(SIDE + 1)))
    begin = F.greatest(F.lit(SIDE) - F.col("pos"), F.lit(0)) + 1
    whole = total(begin, F.least(F.col("length"), F.lit(WIDE + 1) - begin))
    ok = F.when(F.col("length") < REACH, whole >= F.col("length") - F.floor(F.col("length") / SHORT)).otherwise(best >= REACH - SPARE)
    return both.withColumn("same", same).where(ok).select("doc_id", "key", "items", "start")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document with an overlap: doc_id, its items, their number, verified hits (places times items) and the first word hit."""
    found = overlaps(docs, benchmark, least).groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
        F.sum(F.size("items")).alias("n_hits"),
        F.min("start").alias("first_word"),
    )
    # an item without an id is found, but isn't one of the ids
    ids = F.array_compact("item_ids")
    return found.select("doc_id", ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"), "n_hits", "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """Documents whose text overlaps no item."""
    bad = overlaps(docs, benchmark, least).select(F.col("key").alias("_bad")).distinct()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("own"))
    return own.join(bad, F.col("own") == F.col("_bad"), "left_anti").select("row.*")
