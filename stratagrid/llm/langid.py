"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are neither letters nor marks becomes one blank, and the
runs of 1 to 4 characters inside a word, with the blanks around it, are hashed into 2^BITS buckets. Training
counts the buckets of all labelled training texts by language, so no row is sampled: a task adds up its own
texts and hands on a row a language and bucket at most. The model, log probabilities in whole steps of
2^-STEPS, has MAX_LANGUAGES * 2^BITS cells at most, which bounds what the driver collects and what is sent
to tasks. Scores are sums of whole numbers, so they don't depend on how rows are dealt out.

Tasks read a few megabytes of text at a time, and a text's grams in blocks, so that very long texts and
many languages take no more memory.

Defined results: a null text, an empty one and one without a letter is ``und`` with score 0, as is every text
when nothing was learnt; a null id counts as not held out and trains; repeated rows count each; ties go to the language
that comes first by name; more labels than MAX_LANGUAGES are an error; an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import chunks, raw
from stratagrid.llm.toxicity import held_out

ORDERS, BITS, SMOOTH, STEPS = (1, 2, 3, 4), 16, 0.1, 20
MAX_LANGUAGES = 128
#: Bytes of text in a chunk, and numbers gathered from the model at a time.
CHUNK, CELLS = 1 << 20, 1 << 22
BLANK, MULTIPLIER = 32, np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 2 for a letter, 1 for a mark, 0 else; and its lower case, or a blank if it is neither."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.full(sys.maxunicode + 1, BLANK, np.uint32)
    for c in range(sys.maxunicode + 1):
        group = unicodedata.category(chr(c))[0]
        if group in "LM":
            small = chr(c).lower()
            kind[c], lower[c] = 1 + (group == "L"), ord(small) if len(small) == 1 else c
    return kind, lower


def normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts with single blanks around words, the text of each, and which texts have a letter."""
    kind, lower = alphabet()
    held = [np.frombuffer(t.decode(errors="replace").encode("utf-32-le"), np.uint32) for t in texts]
    size = np.array([len(h) + 1 for h in held], np.int64)
    gap = np.array([BLANK], np.uint32)
    points = np.concatenate([x for h in held for x in (h, gap)])
    text = np.repeat(np.arange(len(texts)), size)
    lettered = np.bincount(text[kind[points] == 2], minlength=len(texts)) > 0
    chars = lower[points]
    blank = chars == BLANK
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))  # the first blank of a run; a text's word starts at the one before it
    return np.concatenate([gap, chars[keep]]), np.concatenate([text[:1], text[keep]]), lettered


def grams(chars: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket and the text of every run of that many characters within a word and its blanks."""
    blank = chars == BLANK
    hashed, inner = np.zeros(len(chars), np.uint64), np.zeros(len(chars), bool)
    for k in range(1, ORDERS[-1] + 1):
        n = len(chars) - k + 1
        if n <= 0:
            return
        hashed = (hashed[:n] + chars[k - 1 :] + np.uint64(k)) * MULTIPLIER
        hashed ^= hashed >> np.uint64(29)
        if k > 2:
            inner = inner[:n] | blank[k - 2 : k - 2 + n]
        at = np.flatnonzero(~inner[:n] & ~((k < 3) & blank[:n] & blank[k - 1 :]))
        if k in ORDERS:
            yield (hashed[at] * MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64), text[np.minimum(at + blank[at], len(text) - 1)]


def counted(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Language by bucket: how often the training texts have it."""

    def run(batches):
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, np.int64))
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                texts, names = raw(part.column("text")), part.column("lang").to_pylist()
                for name in sorted(set(names)):
                    chars, text, _ = normal([t for t, x in zip(texts, names, strict=True) if x == name])
                    for bucket, _ in grams(chars, text):
                        held[name] += np.bincount(bucket, minlength=1 << BITS)
        for name, counts in held.items():
            bucket = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), langs.index(name), np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])], ["lang", "bucket", "n"])

    found = rows.select("text", "lang").mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), 1 << BITS), np.int64)
    counts[found.column("lang").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by name, log priors, and bucket by language log probabilities, in steps."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    seen = train.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = [r["lang"] for r in seen]
    counts = counted(train.select("text", F.col("lang").cast("string").alias("lang")), langs)
    total = counts.sum(axis=1, keepdims=True)
    steps = lambda p: np.rint(np.log(p) * (1 << STEPS)).astype(np.int32)
    prior = np.array([r["n"] for r in seen], float)
    return langs, steps(prior / max(1.0, prior.sum())), np.ascontiguousarray(steps((counts + SMOOTH) / (total + SMOOTH * (1 << BITS))).T)


def scored(texts: list[bytes], prior: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text by language log probabilities in steps, and which texts have a letter."""
    chars, text, lettered = normal(texts)
    out = np.repeat(prior.astype(np.int64)[None], len(texts), axis=0)
    step = max(1, CELLS // max(1, model.shape[1]))
    for bucket, of in grams(chars, text):
        for at in range(0, len(bucket), step):
            owners, first = np.unique(of[at : at + step], return_index=True)
            out[owners] += np.add.reduceat(model[bucket[at : at + step]], first, axis=0, dtype=np.int64)
    return out, lettered


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    langs, prior, model = learned(docs)
    sent = docs.sparkSession.sparkContext.broadcast((langs, prior, model))

    def run(batches):
        langs, prior, model = sent.value
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            for part in chunks(batch, size=CHUNK):
                best, score = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows)
                if langs:
                    points, lettered = scored(raw(part.column("text")), prior, model)
                    top = points.max(axis=1, keepdims=True)
                    share = 1.0 / np.exp((points - top) / (1 << STEPS)).sum(axis=1)
                    best, score = np.where(lettered, points.argmax(axis=1), best), np.where(lettered, share, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
