"""Line-first quality rules: bad lines go first, then documents that lost too much.

Every line is judged alone (punctuation, navigation, boilerplate); lines that fail are removed, and
a document is rejected if that removes more than ``MAX_LOSS`` of its words. Two rules over the whole
document stand before that (too few words, repeated 5-word runs).

No shuffle: rows go through one ``mapInArrow``, a few megabytes of text at a time.

Defined results: a null or empty text has no words, fails the word count and is not kept; repeated
rows and ties are judged alike, each alone; an empty table gives an empty table; columns of the input
that clash with the result's are ignored by ``score`` and replaced by ``clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.common import chunks, covered, hash_words, raw, starts_of, windows

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RUN = 5
#: Share of words that may be lost with the removed lines.
MAX_LOSS = 0.5
#: A line of fewer words than this without closing punctuation counts as a heading or menu entry.
SHORT_LINE = 4
#: Shares of a line's words above which decoration makes it fail.
MAX_SYMBOL_WORDS, MAX_SHOUT_WORDS, MAX_SEPARATORS = 0.3, 0.3, 0.2

BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|enable javascript|"
    rb"click here|subscribe to our|sign up for|share this|powered by|lorem ipsum"
)
SYMBOLS = b"#*$%&|<>"
#: Bytes that are no first byte of a word's character: separators and UTF-8 continuation bytes.
NOT_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
CLOSING = (b".", b"!", b"?", b":", b";", b",", b'"', b"'", b")", b"]", "…".encode(), "”".encode(), "»".encode())


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with these words is decoration, navigation or boilerplate."""
    n = len(words)
    if n < SHORT_LINE and not words[-1].endswith(CLOSING):
        return True
    if sum(w in (b"|", b"\xc2\xbb", b">", b"-", b"\xe2\x80\xa2") for w in words) > MAX_SEPARATORS * n:
        return True
    if n >= SHORT_LINE and sum(w.endswith((b"!!", b"??")) for w in words) > MAX_SHOUT_WORDS * n:
        return True
    if len(line) != len(line.translate(None, SYMBOLS)) and sum(len(w) != len(w.translate(None, SYMBOLS)) for w in words) > MAX_SYMBOL_WORDS * n:
        return True
    return bool(BOILERPLATE.search(line.lower()))


def judged(batch: pa.RecordBatch) -> dict[str, list]:
    """Counts, verdict and cleaned text of each row of a small batch with a ``text``."""
    texts = raw(batch.column("text"))
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = hash_words([w for ws in words for w in ws])
    g, doc, at = windows(h, counts, RUN)
    key = g ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    repeat = starts_of(covered(at[times[which] > 1], RUN, len(h)))[starts_of(counts)]
    out = {"n_words": counts.tolist(), "n_repeat_words": np.diff(repeat).tolist()}
    cols = {k: [] for k in ("word_chars", "n_symbols", "n_dup_lines", "n_lost_words", "clean_text")}
    for t in texts:
        full = [(line, w) for line in t.split(b"\n") if (w := line.split())]
        good = [(line, w) for line, w in full if not line_fails(line, w)]
        for k, v in zip(
            cols,
            (
                len(t.translate(None, NOT_CHARS)),
                len(t) - len(t.translate(None, SYMBOLS)),
                len(full) - len({line for line, _ in full}),
                sum(len(w) for _, w in full) - sum(len(w) for _, w in good),
                b"\n".join(line for line, _ in good).decode("utf-8", "replace"),
            ),
            strict=True,
        ):
            cols[k].append(v)
    out |= cols
    out["base_failed"] = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, r in zip(out["n_words"], out["n_repeat_words"], strict=True)]
    out["kept"] = [not b and lost <= MAX_LOSS * n for b, lost, n in zip(out["base_failed"], out["n_lost_words"], out["n_words"], strict=True)]
    return out


KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lost_words": "long", "base_failed": "boolean", "kept": "boolean"}
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, the counts, ``base_failed`` and ``kept``."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = judged(part)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(found[k], ARROW[t]) for k, t in KINDS.items())], ["key", *KINDS])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{k} {t}" for k, t in KINDS.items())).withColumnRenamed("key", key)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Kept documents with all their columns; ``text`` is what is left of it, ``n_chars`` its length if there is one."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, text):
                found = judged(pa.RecordBatch.from_arrays([part.column(at)], ["text"]))
                held = part.set_column(at, pa.field(text, pa.string()), pa.array(found["clean_text"], pa.string()))
                yield held.filter(pa.array(found["kept"], pa.bool_()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
