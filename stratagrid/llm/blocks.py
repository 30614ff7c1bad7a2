"""Blocks of documents that ask shards of a corpus-wide index.

Documents are dealt into blocks of a few megabytes by a hash of their id. A block sends every
*distinct* key that it holds (a phrase, a word, a pair) to the shard that owns the key, packed as one
row of sorted numbers for each shard; the shard answers in the same order, and the answers meet the
block's documents again. So a key that a third of all documents hold costs one entry a block, no row
is made per occurrence, and no task holds more than a shard or a block. The documents' exchange is the
same on both ways, so Spark writes it once.

Blocks and shards grow in number with the corpus, not in size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import mixed

BLOCK_BYTES = 4 << 20
#: Bytes of text for each shard of an index of words or phrases.
SHARD_BYTES = 12 << 20
NULL_ID = np.iinfo(np.int64).min


def blocked(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(block, doc_id, text) of each document, and how many shards an index of the corpus should have."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body)).alias("n")).first()["n"] or 0
    n_blocks, n_shards = max(1, math.ceil(total / BLOCK_BYTES)), max(1, math.ceil(total / SHARD_BYTES))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")
    return docs.select(key.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), body.cast("binary").alias("text")), n_shards


def rows_of(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids (null as the smallest number) and texts of a block, ordered by both: the same however the rows came."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    held = sorted(zip((NULL_ID if i is None else i for i in ids), texts, strict=True))
    return np.array([i for i, _ in held], np.int64), [t for _, t in held]


def dealt(keys: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and the keys' order by shard (stable)."""
    shard = (mixed(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(33)) % np.uint64(n_shards)
    return shard, np.argsort(shard.astype(np.uint16 if n_shards < 1 << 16 else np.int64), kind="stable")


def spread(shard: np.ndarray, order: np.ndarray, n_shards: int) -> list[np.ndarray]:
    """Positions of the keys that each shard gets, in the order they are sent in."""
    return np.split(order, np.searchsorted(shard[order], np.arange(1, n_shards)))


def ids(values: np.ndarray) -> pa.Array:
    """Document ids as Arrow, the smallest number as null."""
    return pa.array(values, pa.int64(), mask=values == NULL_ID)
