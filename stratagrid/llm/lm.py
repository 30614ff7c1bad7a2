"""Word trigram model in Elias-Fano tries, and the score of every text under it.

Training counts words, pairs and triples of neighbours over all training texts; nothing is pruned. Keys
are dealt to shards by the whole n-gram (see ``blocks``), so those of a frequent context lie in many
shards. A shard lays each order out as a trie in one run of bytes (``Trie``): an Elias-Fano list of
its contexts' fingerprints, the monotone pointers from contexts to their children, an Elias-Fano list
of the children (a context's rank above a word's fingerprint) and for each n-gram a quantised
logarithm of its probability, as the count it has among N. A query finds its context, then its word by
successor search among that context's children alone; all of it runs on the packed bytes. ``build``
gives the tries as rows to be kept in the shared folder, and ``score_by`` scores any texts by such a
model; ``score`` asks the tries in the tasks that build them, which saves writing them (at 3 orders
they take about as much disk as the texts).

With p(w) = (c(w) + 1) / (N + V + 1) the model is
    p(w | v)   = (c(v w)   + MU2 p(w))     / (c(v)   + MU2)
    p(w | u v) = (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3),
a proper distribution for every context up to quantisation: MU2 and MU3 are the weights of the back-off.
Context totals are no single shard's, so probabilities are put together where a text is scored, from
its own n-grams' entries. A text starts behind two end tokens and ends with one.

Fingerprints of an n-gram have SPARE_BITS bits more than it takes to number the corpus' bytes: half of
those bits for the context, the others and the spare ones for the word, under a hash that depends on the
whole context. So at any size about one n-gram in 2^SPARE_BITS shares its entry, also among the
children of one context as long as these are fewer than the root of the bytes; words have 64 bits.

Defined results: a null text is empty, so it has the end token alone; a null id is in training;
repeated rows count as often as they stand there; an empty table gives an empty table; without any
training text counts are zero; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.blocks import NULL_ID, SHARD_BYTES, blocked, dealt, ids, spread
from stratagrid.llm.common import hash_words, mixed, opened, packed, planes, squeezed, starts_of, unpacked, unplaned

#: Weights of the back-off, in pairs and in triples.
MU2, MU3 = 400.0, 20.0
#: Steps of the quantised logarithm for each factor of 10.
STEPS = 4096
SPARE_BITS = 14
END = hash_words([b"\n"])[0]  # no word holds a line break
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Where the k-th set bit of a byte is.
_NTH = np.array([([j for j in range(8) if i >> j & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)


def _nth(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit of ``words``, given the set bits before each word."""
    at = np.searchsorted(before, k, side="right") - 1
    parts = np.ascontiguousarray(words[at]).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_ONES[parts], axis=1, dtype=np.int64)
    left = k - before[at]
    byte = np.minimum((upto <= left[:, None]).sum(axis=1), 7)
    row = np.arange(len(k))
    left = np.minimum(left - np.where(byte > 0, upto[row, byte - 1], 0), 7)
    return at * 64 + byte * 8 + _NTH[parts[row, byte], left]


class EliasFano:
    """A non-decreasing list: low bits packed, high bits in unary, with a count of ones for each word of 64 bits; a view of bytes."""

    @staticmethod
    def coded(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        parts = (low[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) for i in range(0, n, 1 << 16))  # whole bytes each
        packed_low = b"".join(np.packbits(np.unpackbits(x, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes() for x in parts) + b"\0" * 8
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        head = np.array([n, bits, len(packed_low) + -len(packed_low) % 8, len(unary) // 64], np.int64).tobytes()
        return head + packed_low + b"\0" * (-len(packed_low) % 8) + np.packbits(unary, bitorder="little").tobytes()

    def __init__(self, held: memoryview) -> None:
        self.n, self.bits, low, words = (int(x) for x in np.frombuffer(held, np.int64, 4))
        self.low = np.ndarray((low - 7,), "<u8", held, 32, (1,))  # eight bytes from each byte on
        self.words = np.frombuffer(held, np.uint64, words, 32 + low)
        ones = _ONES[self.words.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.ones = starts_of(ones)[:-1]
        self.zeros = np.arange(words, dtype=np.int64) * 64 - self.ones
        self.buckets = words * 64 - self.n  # zeros in all
        self.size = 32 + low + 8 * words

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.low[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def _first(self, high: np.ndarray) -> np.ndarray:
        """Entries whose high part is below each value."""
        return np.where(high > 0, _nth(~self.words, self.zeros, np.maximum(high - 1, 0)) - (high - 1), 0)

    def find(self, asked: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Where each of ``asked`` stands, -1 if it doesn't: the successor in its bucket, and in [least, most) if given."""
        high = (asked >> np.uint64(self.bits)).astype(np.int64)
        inside = high + 1 < self.buckets
        bucket = np.where(inside, high, 0)
        lo, hi = self._first(bucket), np.where(inside, self._first(bucket + 1), 0)
        if least is not None:
            lo, hi = np.maximum(lo, least), np.minimum(hi, most)
        want, end = asked & np.uint64((1 << self.bits) - 1), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = np.full(len(asked), -1, np.int64)
        ok = np.flatnonzero(lo < end)
        ok = ok[self._low(lo[ok]) == want[ok]]
        found[ok] = lo[ok]
        return found

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at ``i``."""
        high = _nth(self.words, self.ones, i) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)


class Trie:
    """n-grams of one order and their quantised logarithms, as levels in one run of bytes.

    A key has a context's fingerprint above the ``low`` bits of a word's.
    """

    @staticmethod
    def coded(keys: np.ndarray, counts: np.ndarray, low: int) -> bytes:
        context, begin = np.unique(keys >> np.uint64(low), return_index=True)
        rank = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(np.append(begin, len(keys))))
        word = keys & np.uint64((1 << low) - 1)
        levels = (
            EliasFano.coded(context, int(context[-1]) + 1 if len(context) else 1),
            EliasFano.coded(np.append(begin, len(keys)).astype(np.uint64), len(keys) + 1),
            EliasFano.coded((rank << np.uint64(low)) | word, max(1, len(context)) << low),
        )
        return np.array([low], np.int64).tobytes() + b"".join(levels) + np.round(np.log10(counts) * STEPS).astype(np.uint16).tobytes()

    def __init__(self, held: bytes) -> None:
        view, at, levels = memoryview(held), 8, []
        self.bits = int(np.frombuffer(view, np.int64, 1)[0])
        for _ in range(3):
            levels.append(EliasFano(view[at:]))
            at += levels[-1].size
        self.contexts, self.pointers, self.children = levels
        self.codes = np.frombuffer(view, np.uint16, self.children.n, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """1 + the quantised logarithm of each n-gram's count, 0 for one that is not there."""
        context = self.contexts.find(keys >> np.uint64(self.bits))
        out = np.zeros(len(keys), np.uint32)
        known = np.flatnonzero(context >= 0)
        if len(known):
            c = context[known]
            least, most = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
            at = self.children.find((c.astype(np.uint64) << np.uint64(self.bits)) | (keys[known] & np.uint64((1 << self.bits) - 1)), least, most)
            out[known[at >= 0]] = self.codes[at[at >= 0]].astype(np.uint32) + 1
        return out


def keys_of(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """n-gram keys for a corpus whose bytes take ``bits`` bits to number: a context's fingerprint above one of the word that depends on the whole context."""
    high, low = bits // 2, SPARE_BITS + bits - bits // 2
    return ((mixed(context) >> np.uint64(64 - high)) << np.uint64(low)) | (mixed(context * np.uint64(0x9E3779B97F4A7C15) ^ word) >> np.uint64(64 - low))


def tokens(table: pa.Table, bits: int):
    """Ids, training flags, lengths and begins of a block's texts, token hashes, and keys of the pair and the triple that each token ends."""
    held = sorted(zip((NULL_ID if i is None else i for i in table.column("doc_id").to_pylist()), table.column("train").to_pylist(), table.column("text").to_pylist(), strict=True))
    words = [t.lower().split() for _, _, t in held]
    counts = np.array([len(w) + 1 for w in words], np.int64)
    begin = starts_of(counts)
    h = np.full(int(begin[-1]), END, np.uint64)
    body = np.ones(len(h), bool)
    body[begin[1:] - 1] = False
    h[body] = hash_words([w for ws in words for w in ws])
    before = np.concatenate([[END], h[:-1]])
    second = np.concatenate([[END], before[:-1]])
    second[begin[:-1]] = END  # a text starts behind two end tokens
    pair = keys_of(before, h, bits)
    triple = keys_of(mixed(second ^ np.uint64(0x5851F42D4C957F2D)) + before, h, bits)
    return np.array([i for i, _, _ in held], np.int64), np.array([t for _, t, _ in held], bool), counts, begin, h, pair, triple


class Deal:
    """The keys of a block by order and shard: words (0), pairs (1) and triples (2); the same for who sends and who gets answers."""

    def __init__(self, n_shards: int, bits: int) -> None:
        self.n_shards, self.bits = n_shards, bits

    def keys(self, found) -> list[tuple[np.ndarray, np.ndarray]]:
        """Different keys of each order and the place of each token's among them; the last of the pairs is a text's first context, two end tokens."""
        *_, h, pair, triple = found
        start = keys_of(np.array([END]), np.array([END]), self.bits)
        return [np.unique(x, return_inverse=True) for x in (h, np.append(pair, start), triple)]

    def sent(self, table: pa.Table) -> pa.Table:
        found = tokens(table, self.bits)
        used = np.repeat(found[1], found[2])
        rows = []
        for order, (own, place) in enumerate(self.keys(found)):
            times = np.bincount(place[: len(used)], weights=used, minlength=len(own)).astype(np.uint32)
            if order == 1:  # the first context is no pair of the text but counts as often as texts
                times[place[-1]] += np.uint32(found[1].sum())
            for s, p in enumerate(spread(*dealt(own, self.n_shards), self.n_shards)):
                if len(p) or not order:  # every shard of words hears of every block, so that every block learns N and V
                    rows.append((order * self.n_shards + s, squeezed(planes(own[p])), squeezed(packed(times[p]))))
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "shard": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "times": pa.array([r[2] for r in rows], pa.binary())})

    def merged(self, table: pa.Table):
        keys = [unplaned(opened(x)) for x in table.column("keys").to_pylist()]
        times = np.concatenate([unpacked(opened(x)) for x in table.column("times").to_pylist()])
        own, which = np.unique(np.concatenate(keys), return_inverse=True)
        return starts_of(np.array([len(k) for k in keys])), own, which, np.bincount(which, weights=times, minlength=len(own)).astype(np.int64)

    def model(self, own: np.ndarray, count: np.ndarray, order: int) -> bytes:
        """A shard's part of the model: words as sorted hashes and counts, n-grams as a trie."""
        own, count = own[count > 0], count[count > 0]
        return Trie.coded(own, count, SPARE_BITS + self.bits - self.bits // 2) if order else np.array([len(own)], np.int64).tobytes() + own.tobytes() + count.tobytes()

    def asked(self, held: bytes, own: np.ndarray, order: int) -> tuple[np.ndarray, int, int]:
        """What a shard's part says of ``own`` (counts of words, codes of n-grams), and its tokens and different words."""
        if order:
            return Trie(held).find(own), 0, 0
        n = int(np.frombuffer(held, np.int64, 1)[0])
        words, counts = np.frombuffer(held, np.uint64, n, 8), np.frombuffer(held, np.int64, n, 8 + 8 * n)
        at = np.minimum(np.searchsorted(words, own), max(0, n - 1))
        found = np.where(words[at] == own, counts[at], 0) if n else np.zeros(len(own), np.int64)
        return found.astype(np.uint64), int(counts.sum()), n

    def answers(self, table: pa.Table, ends: np.ndarray, found: np.ndarray, n: int, v: int) -> pa.Table:
        parts = [squeezed(packed(found[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "found": pa.array(parts, pa.binary()), "n": pa.array([n] * len(parts), pa.int64()), "v": pa.array([v] * len(parts), pa.int64())})

    def scored(self, left: pa.Table, right: pa.Table) -> pa.Table:
        found = tokens(left, self.bits)
        doc_ids, train, counts, begin, h, _, _ = found
        answers = dict(zip(right.column("shard").to_pylist(), right.column("found").to_pylist(), strict=True))
        n, v = (sum(x or 0 for x in right.column(c).to_pylist()) for c in ("n", "v"))
        known = []
        for order, (own, place) in enumerate(self.keys(found)):
            held = np.zeros(len(own), np.int64)
            for s, p in enumerate(spread(*dealt(own, self.n_shards), self.n_shards)):
                if len(p) and order * self.n_shards + s in answers:
                    held[p] = unpacked(opened(answers[order * self.n_shards + s]))
            known.append((held.astype(float) if not order else np.where(held > 0, 10.0 ** ((held - 1) / STEPS), 0.0))[place])
        own, pairs, triples = known
        first = begin[:-1]
        before, lead = np.concatenate([[0.0], own[:-1]]), np.concatenate([[0.0], pairs[: len(h) - 1]])
        if len(first):
            before[first], lead[first] = own[begin[1] - 1], pairs[-1]  # of the end token, and of two
        base = (own + 1) / (n + v + 1)
        two = (pairs[: len(h)] + MU2 * base) / (before + MU2)
        three = (triples + MU3 * two) / (lead + MU3)
        doc = np.repeat(np.arange(len(counts)), counts)
        total = lambda x: np.bincount(doc, weights=x, minlength=len(counts))
        return pa.table(
            {
                "doc_id": ids(doc_ids),
                "held_out": pa.array(~train),
                "n_tokens": pa.array(counts, pa.int64()),
                "n_known": pa.array(total(own > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(counts), n, np.int64)),
                "base_score": pa.array(total(np.log10(base))),
                "score": pa.array(total(np.log10(three))),
                "pair_score": pa.array(total(np.log10(two))),
            }
        )


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, pair_score double"
SENT, ANSWERS = "block int, shard int, keys binary, times binary", "block int, shard int, found binary, n long, v long"


def trained(docs: DataFrame, fold: int, held: int) -> tuple[DataFrame, int, int]:
    """Blocks with training flags, shards, and the bits that it takes to number the corpus' bytes, to a shard."""
    blocks, n_shards = blocked(docs)
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == held, F.lit(False))
    return blocks.withColumn("train", ~out), n_shards, min(64 - SPARE_BITS, (n_shards * SHARD_BYTES).bit_length())


def build(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """The model of all training texts: shard, part (bytes), n_shards and bits, a row for each shard; to be written to the shared folder."""
    blocks, n_shards, bits = trained(docs, fold, held)
    deal = Deal(n_shards, bits)

    def part(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        _, own, _, count = deal.merged(table)
        return pa.table({"shard": pa.array([shard], pa.int32()), "part": pa.array([deal.model(own, count, shard // n_shards)], pa.binary())})

    parts = blocks.groupBy("block").applyInArrow(lambda t: deal.sent(t), SENT).groupBy("shard").applyInArrow(part, "shard int, part binary")
    return parts.withColumns({"n_shards": F.lit(n_shards), "bits": F.lit(bits)})


def score_by(model: DataFrame, docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """The scores of ``docs`` by a model that ``build`` has made, of these or of other texts."""
    shape = model.select("n_shards", "bits").first()
    deal = Deal(*shape)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "found": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        ends, own, which, _ = deal.merged(left)
        order = left.column("shard")[0].as_py() // deal.n_shards
        found, n, v = deal.asked(right.column("part")[0].as_py(), own, order) if right.num_rows else (np.zeros(len(own), np.int64), 0, 0)
        return deal.answers(left, ends, found[which], n, v)

    blocks = trained(docs, fold, held)[0]
    sent = blocks.groupBy("block").applyInArrow(lambda t: deal.sent(t), SENT)
    answers = sent.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(resolve, ANSWERS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: deal.scored(a, b), SCORES)


def score(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and the pairs' score of every text; rows of fold ``held`` train nothing."""
    blocks, n_shards, bits = trained(docs, fold, held)
    deal = Deal(n_shards, bits)

    def resolve(table: pa.Table) -> pa.Table:
        ends, own, which, count = deal.merged(table)
        order = table.column("shard")[0].as_py() // n_shards
        found, n, v = deal.asked(deal.model(own, count, order), own, order)
        return deal.answers(table, ends, found[which], n, v)

    sent = blocks.groupBy("block").applyInArrow(lambda t: deal.sent(t), SENT)
    answers = sent.groupBy("shard").applyInArrow(resolve, ANSWERS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: deal.scored(a, b), SCORES)
