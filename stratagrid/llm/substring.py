"""Exact repeated passages by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut in blocks: each phrase of SPAN words of each block is an anchor
in the shard of its hash, with the document and the word where it first starts (see ``blocks``). A
document is parsed from left to right against all reference blocks: where a phrase starts earlier in
the corpus, a factor (start, end, source, source_start) begins there and is extended word by word as
long as the anchors say that the first occurrence goes on at the source; where none does, a word is a
literal, and the parse goes on behind the factor or the literal. Factors and literals rebuild the
document (``rebuilt``). Factors have SPAN words at least, so each is a duplicate span. Around each
factor's ends the phrases that go over the boundary are looked up as well (``seams``), as a factor of
one source may stop inside a phrase that another source holds; with these the spans are exactly the
words of windows that start earlier in the corpus.

Hashes have 64 bits besides those of the shard's number, so the chance of any false match stays near
n^2 / 2^65 / shards for n different phrases (0.0001 for 10^8); words are not compared again.

Defined results: "earlier" is a smaller doc_id, or the same one and an earlier start; a null id is
smaller than all; rows with the same id are one document in this sense, so a factor's source is in one
of them; null and empty texts have no words; an empty table gives an empty table; other columns of the
input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratagrid.llm.blocks import blocked, dealt, ids, rows_of, spread
from stratagrid.llm.common import hash_words, opened, planes, squeezed, starts_of, unplaned, windows

SPAN = 20


def phrases(doc_ids: np.ndarray, texts: list[bytes], span: int):
    """Words and counts of a block, and of its windows: document, start in the block's words, number of the phrase; for each phrase its hash and first window."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    g, doc, at = windows(hash_words([w for ws in words for w in ws]), counts, span)
    own, first, which = np.unique(g, return_index=True, return_inverse=True)
    # windows are ordered by id, row, start; of rows with one id the earliest start comes first
    begin = starts_of(counts)
    ties = np.flatnonzero(doc_ids[1:] == doc_ids[:-1])
    if len(ties):
        order = np.lexsort((at - begin[doc], doc_ids[doc], which))
        first = order[np.searchsorted(which[order], np.arange(len(own)))]
    return words, counts, doc, at, which, own, first


def steps_of(doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Starts of phrases in the order of ids and starts, as steps inside each document: small numbers, which compress."""
    step = np.diff(starts, prepend=0)
    new = np.concatenate([[True], doc_ids[1:] != doc_ids[:-1]])
    step[new] = starts[new]
    return planes(np.cumsum(step).astype(np.uint64))


def starts_from(doc_ids: np.ndarray, held: bytes) -> np.ndarray:
    total = unplaned(held).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], doc_ids[1:] != doc_ids[:-1]]))
    before = np.where(new > 0, total[new - 1], 0)
    return total - np.repeat(before, np.diff(np.append(new, len(total))))


def parsed(hit: np.ndarray, doc: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of all documents of a block, as (first hit, last hit); and the hits that go over factors' boundaries.

    ``hit`` are the windows with an earlier source, in order; ``doc``, ``at``, ``source`` and ``start`` are theirs.
    """
    if not len(hit):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    on = (np.diff(at) == 1) & (np.diff(doc) == 0) & (np.diff(source) == 0) & (np.diff(start) == 1)
    run = np.cumsum(np.concatenate([[0], ~on]))  # hits whose source goes on share a run
    last_of = np.append(np.flatnonzero(~on), len(hit) - 1)
    factors, k, inside = [], 0, np.zeros(len(hit), bool)
    while k < len(hit):
        last = last_of[run[k]]
        factors.append((k, last))
        inside[k : last + 1] = True
        # the parse goes on behind the factor's last word, at the next hit of this document or of a later one
        d, end = doc[k], at[last] + span
        k = last + 1
        while k < len(hit) and doc[k] == d and at[k] < end:
            k += 1
    return np.array(factors, np.int64), np.flatnonzero(~inside)


def rebuilt(words: list[list[bytes]], factors: list[list[tuple]]) -> list[list[bytes]]:
    """Documents from their literals and factors; a factor is (start, end, number of the source document, source_start)."""
    out: list[list[bytes]] = []
    for own, found in zip(words, factors, strict=True):
        out.append([])
        at = 0
        for start, end, source, source_start in found:
            out[-1] += own[at:start]
            for i in range(end - start):  # word by word: a source may be this document, and overlap
                out[-1].append(out[source][source_start + i])
            at = end
        out[-1] += own[at:]
    return out


FACTOR = "array<struct<start:bigint,end:bigint,source:bigint,source_start:bigint>>"


def duplicates(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (kept words joined by a space), the factors and the seams between them."""
    blocks, n_shards = blocked(docs)

    def anchors(doc_ids, texts):
        """What a block knows, and its different phrases in the order of their first starts: hash, document, start."""
        words, counts, doc, at, which, own, first = phrases(doc_ids, texts, span)
        order = np.argsort(first, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin = starts_of(counts)
        return words, counts, begin, doc, at, place[which], own[order], doc_ids[doc[first[order]]], at[first[order]] - begin[doc[first[order]]]

    def send(table: pa.Table) -> pa.Table:
        keys, source, start = anchors(*rows_of(table))[-3:]
        parts = [(s, p) for s, p in enumerate(spread(*dealt(keys, n_shards), n_shards)) if len(p)]
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()),
                "shard": pa.array([s for s, _ in parts], pa.int32()),
                "keys": pa.array([keys[p].tobytes() for _, p in parts], pa.binary()),
                "ids": pa.array([squeezed(planes(source[p].view(np.uint64))) for _, p in parts], pa.binary()),
                "starts": pa.array([squeezed(steps_of(source[p], start[p])) for _, p in parts], pa.binary()),
            }
        )

    def resolve(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        owners = [unplaned(opened(x)).view(np.int64) for x in table.column("ids").to_pylist()]
        held = np.concatenate(owners)
        at = np.concatenate([starts_from(i, opened(x)) for i, x in zip(owners, table.column("starts").to_pylist(), strict=True)])
        ends = starts_of(np.array([len(k) for k in keys]))
        k = np.concatenate(keys)
        order = np.lexsort((at, held, k))
        k = k[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.empty(len(k), np.int64)
        first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        source, shift = held[first], (at[first] - at).astype(np.int64)  # along a factor the shift stays, so it compresses
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "ids": pa.array([squeezed(planes(source[a:b].view(np.uint64))) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                "shifts": pa.array([squeezed(planes(shift[a:b].view(np.uint64))) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            }
        )

    def parse(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, texts = rows_of(left)
        words, counts, begin, doc, at, place, keys, own_id, own_start = anchors(doc_ids, texts)
        parts = spread(*dealt(keys, n_shards), n_shards)
        source, source_start = own_id.copy(), own_start.copy()
        for s, x, y in zip(right.column("shard").to_pylist(), right.column("ids").to_pylist(), right.column("shifts").to_pylist(), strict=True):
            source[parts[s]] = unplaned(opened(x)).view(np.int64)
            source_start[parts[s]] += unplaned(opened(y)).view(np.int64)
        start = at - begin[doc]
        src, src_start = source[place], source_start[place]
        hit = np.flatnonzero((src < doc_ids[doc]) | ((src == doc_ids[doc]) & (src_start < start)))
        w, d, src, src_start = at[hit], doc[hit], src[hit], src_start[hit]
        found, over = parsed(hit, d, w, src, src_start, span)
        steps = np.zeros(int(begin[-1]) + 1, np.int32)
        for opens, closes in ((w[found[:, 0]], w[found[:, 1]] + span), (w[over], w[over] + span)):
            np.add.at(steps, opens, 1)
            np.add.at(steps, closes, -1)
        gone = np.cumsum(steps[:-1]) > 0
        removed = np.diff(starts_of(gone)[begin])
        kept = [b" ".join([x for x, y in zip(ws, gone[a:b].tolist(), strict=True) if not y] if r else ws) for ws, a, b, r in zip(words, begin[:-1], begin[1:], removed, strict=True)]

        def listed(first, last):
            spans = pa.StructArray.from_arrays(
                [pa.array(w[first] - begin[d[first]], pa.int64()), pa.array(w[last] + span - begin[d[first]], pa.int64()), ids(src[first]), pa.array(src_start[first], pa.int64())],
                ["start", "end", "source", "source_start"],
            )
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(d[first], np.arange(len(counts) + 1)).astype(np.int32)), spans)

        return pa.table(
            {
                "doc_id": ids(doc_ids),
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                "factors": listed(found[:, 0], found[:, 1]),
                "seams": listed(over, over),
            }
        )

    sent = blocks.groupBy("block").applyInArrow(send, "block int, shard int, keys binary, ids binary, starts binary")
    answers = sent.groupBy("shard").applyInArrow(resolve, "block int, shard int, ids binary, shifts binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(parse, f"doc_id long, n_words long, n_removed long, kept_text string, factors {FACTOR}, seams {FACTOR}")
