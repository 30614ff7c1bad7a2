"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard.

1. A shingle is a run of SHINGLE words (a shorter text: all its words). Equal texts are one vertex.
   Over the N different texts the document frequency df of every shingle is counted: blocks of texts
   send their distinct shingles to the shards that own them and get the counts back (see ``blocks``),
   to an eighth of a doubling. Counters have keys that widen with the corpus, so that at any size fewer
   than one shingle in 2^SPARE_BITS shares its counter. A shingle weighs tf * (1 + log(N / df) / log N): its idf goes from 1, for
   one that all texts share, to 2, for one of a single text, whatever the size of the corpus.
2. Improved consistent weighted sampling gives SAMPLES samples (shingle, level) of each text; two texts
   share one with a probability equal to their weighted Jaccard similarity. BANDS bands of ROWS samples
   make the buckets: a pair at 0.8 shares one with probability 0.999.
3. A bucket is never compared all with all. Its members are ordered by the samples that follow the
   band's, as in a forest of prefix trees, so that the most similar ones are neighbours, and each is a
   candidate with the NEXT ones behind it, in each of its buckets. The order is a range partitioning by
   (bucket, samples, vertex), which cuts hot buckets anywhere; the ends of neighbouring ranges meet in a
   second, narrow pass. So a text has at most 2 BANDS NEXT candidates, in a group of any size, and a
   group's links hold it together through its many orders.
4. Candidates whose sketches (a byte a sample) agree in fewer than a link would by 3 deviations are
   dropped; the others are verified on their whole texts, with the weights of step 1.
5. Verified links are joined to connected components by passing smallest labels along links and jumping.
6. What the neighbours leave out is made up for: of every bucket whose members aren't all in one component
   by now, all pairs from different components are compared on whole texts, in cells of CELL members that are dealt over
   the tasks. In a small bucket a text is left out that is surely no link of any other part's: each text has its
   weights added up in bins (``binned``), and the bins of two texts differ by no more than their weights do. So no
   link is lost here to sketches, and a pair inside a component can't change a class: the
   classes are those of all pairs of all buckets. ``links(docs, every=True)`` compares those as well and
   gives every link. The work, not the rows, grows with the square of those members of a group that aren't linked yet.

Two numbers (N and the bytes of all texts) and a map of fixed size reach the driver. Texts are shuffled
once for the counts; after that only those of candidate pairs move. A text that a third of all rows hold leaves a task once.

Defined results: null texts are in a class of their own each, their row's; texts without words are
near duplicates only of equal texts; class_id is the smallest id in the class (null ids count as
larger than all); repeated rows are one class; an empty table gives an empty table; other columns of
the input are not read (``keep`` returns them, whatever their names).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.llm import blocks as sizes
from stratagrid.llm.blocks import dealt, spread
from stratagrid.llm.common import chunks, hash_words, mixed, packed, planes, raw, starts_of, unpacked, unplaned, windows
from stratagrid.session import dropped, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Samples behind a band's own that order its bucket.
DEEP = 8
#: Neighbours behind it in that order that a text is compared with.
NEXT = 5
#: Members of a bucket that are held against each other, or against another cell, at once, and about the bytes of their texts.
CELL = 256
CELL_BYTES = 1 << 20
#: Agreeing samples, as a share, below which neighbours aren't verified at first: 3 deviations below the threshold.
LEAST_ALIKE = THRESHOLD - 3 * (THRESHOLD * (1 - THRESHOLD) / SAMPLES) ** 0.5
#: Bins of a text's weights: about one a shingle, between these; and parts of a weight of 1 that a bin counts in.
LEAST_BINS, MOST_BINS, BIN_PARTS = 16, 4096, 16
#: Steps of a frequency's code for each doubling.
STEPS = 8
#: Counters of frequencies have keys of so many bits more than it takes to number the corpus' bytes.
SPARE_BITS = 16
#: A map of 2^MAP_BITS bits tells which texts are sure to be in no pair; it only saves their shuffle.
MAP_BITS = 25
SEED = 7
_TABLE = 1 << 16


def shingled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in turn: hash, count in the text, and number of the text."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    h = hash_words([w for ws in words for w in ws])
    g, doc, _ = windows(h, counts, SHINGLE)
    short = [(i, w) for i, w in enumerate(words) if 0 < len(w) < SHINGLE]
    if short:
        g = np.concatenate([g, mixed(hash_words([b" ".join(w) for _, w in short]))])
        doc = np.concatenate([doc, np.array([i for i, _ in short])])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])])) if len(g) else np.zeros(0, np.int64)
    return g[new], np.diff(np.append(new, len(g))), doc[new]


def rarity(code: np.ndarray, n: int) -> np.ndarray:
    """The idf of shingles by the code of their frequency among ``n`` texts."""
    return np.clip(2 - code.astype(np.float64) / STEPS * math.log(2) / math.log(max(2, n)), 1, 2)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sample and each value of 16 bits: r and log c from Gamma(2, 1), beta uniform."""
    rng = np.random.default_rng(SEED)
    return rng.gamma(2.0, 1.0, (SAMPLES, _TABLE)).astype(np.float32) + np.float32(1e-6), np.log(rng.gamma(2.0, 1.0, (SAMPLES, _TABLE)) + 1e-12).astype(np.float32), rng.random((SAMPLES, _TABLE), np.float32)


def sampled(g: np.ndarray, weight: np.ndarray, doc: np.ndarray, drawn) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and the SAMPLES samples of each, as hashes."""
    r_all, c_all, b_all = drawn
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(g) else np.zeros(0, np.int64)
    samples = np.empty((SAMPLES, len(new)), np.uint64)
    if not len(new):
        return new, samples
    size = np.diff(np.append(new, len(g)))
    log_w = np.log(weight).astype(np.float32)
    i, j, k = ((g >> np.uint64(s)).astype(np.int64) & (_TABLE - 1) for s in (0, 16, 32))
    for s in range(SAMPLES):
        r = r_all[s][i]
        level = np.floor(log_w / r + b_all[s][k])
        a = c_all[s][j] - r * (level - b_all[s][k] + 1)
        at = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, new), size))
        at = at[np.searchsorted(at, new)]  # the first of ties
        samples[s] = mixed(g[at] ^ (level[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return doc[new], samples


def places(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (row) and band: the bucket, and eight bytes of further samples, the order inside it."""
    buckets, orders = (np.empty((samples.shape[1], BANDS), np.uint64) for _ in range(2))
    for b in range(BANDS):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for s in range(b * ROWS, (b + 1) * ROWS):
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + samples[s])
        order = np.zeros(samples.shape[1], np.uint64)
        for d in range(DEEP):
            order = (order << np.uint64(8)) | (samples[((b + 1) * ROWS + d) % SAMPLES] & np.uint64(255))
        buckets[:, b], orders[:, b] = key, order
    return buckets, orders


def binned(g: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A text's weights added up by the low bits of its shingles, in whole parts rounded down, 255 at most."""
    n = min(MOST_BINS, max(LEAST_BINS, 1 << (len(g) - 1).bit_length()))
    return np.minimum(255, np.bincount((g & np.uint64(n - 1)).astype(np.int64), weight * BIN_PARTS, n)).astype(np.uint8)


def differing(one: np.ndarray, two: np.ndarray) -> float:
    """By how much the weights of two texts differ at least: bins of bins can only be nearer to each other, and so can rounded and cut ones, but for less than a part each."""
    n, most = min(len(one), len(two)), max(len(one), len(two))
    a, b = (x.reshape(-1, n).sum(axis=0, dtype=np.int64) for x in (one, two))
    return float(np.maximum(np.abs(a - b) - most // n, 0).sum()) / BIN_PARTS


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, vertex (digest of the text, null for a null text) and text."""
    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("v"), F.col("text").cast("binary").alias("text"))


def once(docs: DataFrame, known=None) -> DataFrame:
    """(v, text) of all texts, or of those that the broadcast map ``known`` holds and few others; copies in one task are one row."""

    def run(batches):
        seen = set()
        for batch in batches:
            first = []
            for v in batch.column("v").to_pylist():
                first.append(v not in seen and (known is None or bool(known.value[slot(v) >> 3] >> (slot(v) & 7) & 1)))
                if first[-1]:
                    seen.add(v)
            yield batch.filter(pa.array(first, pa.bool_()))

    return keyed(docs).where("v is not null").select("v", "text").mapInArrow(run, "v binary, text binary")


def slot(v: bytes) -> int:
    return int.from_bytes(v[:8], "big") >> (64 - MAP_BITS)


def mapped(vertices: DataFrame):
    """A broadcast map with the bits of all ``vertices``; at most 2^(MAP_BITS - 5) rows reach the driver."""
    at = F.shiftrightunsigned(F.conv(F.hex(F.substring("v", 1, 4)), 16, 10).cast("long"), 32 - MAP_BITS)
    bits = vertices.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 31))")).alias("bits"))
    held = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    for r in bits.collect():
        held[r["cell"]] = r["bits"]
    return vertices.sparkSession.sparkContext.broadcast(held.astype("<u4").tobytes())


def of_block(table: pa.Table, bits: int) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The block's vertices in order, their shingles, the different counters of these, and for each shingle the place of its counter."""
    held = sorted(dict(zip(table.column("v").to_pylist(), table.column("text").to_pylist(), strict=True)).items())
    found = shingled([t for _, t in held])
    own, which = np.unique(found[0] >> np.uint64(64 - bits), return_inverse=True)
    return [v for v, _ in held], found, own, which


def signed(docs: DataFrame) -> tuple[DataFrame, int]:
    """For each different text with words: v, sketch, places in its buckets, codes (the frequency of each of its shingles, by hash), weight (of all of them) and bins. And N."""
    rows = keyed(docs).where("v is not null")
    total, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_distinct("v")).first()
    n_blocks, n_shards = max(1, math.ceil(total / sizes.BLOCK_BYTES)), max(1, math.ceil(total / sizes.SHARD_BYTES))
    bits = min(64, SPARE_BITS + int(total).bit_length())
    texts = once(docs).select(F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int").alias("block"), "v", "text")

    def send(table: pa.Table) -> pa.Table:
        _, _, own, which = of_block(table, bits)
        times = np.bincount(which, minlength=len(own))
        sent = [(s, planes(own[p]), packed(times[p])) for s, p in enumerate(spread(*dealt(own, n_shards), n_shards)) if len(p)]
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(sent), pa.int32()), "shard": pa.array([x[0] for x in sent], pa.int32()), "keys": pa.array([x[1] for x in sent], pa.binary()), "times": pa.array([x[2] for x in sent], pa.binary())})

    def resolve(table: pa.Table) -> pa.Table:
        keys = [unplaned(x) for x in table.column("keys").to_pylist()]
        times = np.concatenate([unpacked(x) for x in table.column("times").to_pylist()])
        own, which = np.unique(np.concatenate(keys), return_inverse=True)
        code = np.minimum(255, np.round(STEPS * np.log2(np.bincount(which, weights=times)))).astype(np.uint8)[which]
        ends = starts_of(np.array([len(k) for k in keys]))
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "codes": pa.array([code[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        vs, (g, tf, doc), own, which = of_block(left, bits)
        answers = dict(zip(right.column("shard").to_pylist(), right.column("codes").to_pylist(), strict=True))
        code = np.zeros(len(own), np.uint8)
        for s, p in enumerate(spread(*dealt(own, n_shards), n_shards)):
            if len(p):
                code[p] = np.frombuffer(answers[s], np.uint8)
        code = code[which]
        weight = tf * rarity(code, n)
        at, samples = sampled(g, weight, doc, tables())
        buckets, orders = places(samples)
        begin = np.searchsorted(doc, np.append(at, len(vs)))
        own_rows = [slice(a, b) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        place = pa.StructArray.from_arrays([pa.array(buckets.ravel().view(np.int64)), pa.array(orders.ravel().view(np.int64))], ["bucket", "deep"])
        sketch = np.ascontiguousarray((samples & np.uint64(255)).astype(np.uint8).T)
        return pa.table(
            {
                "v": pa.array([vs[i] for i in at], pa.binary()),
                "sketch": pa.array([row.tobytes() for row in sketch], pa.binary()),
                "places": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), place),
                "codes": pa.array([code[x].tobytes() for x in own_rows], pa.binary()),
                "weight": pa.array([float(weight[x].sum()) for x in own_rows], pa.float64()),
                "bins": pa.array([binned(g[x], weight[x]).tobytes() for x in own_rows], pa.binary()),
            }
        )

    sent = texts.groupBy("block").applyInArrow(send, "block int, shard int, keys binary, times binary")
    answers = sent.groupBy("shard").applyInArrow(resolve, "block int, shard int, codes binary")
    return stored(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sign, "v binary, sketch binary, places array<struct<bucket:bigint,deep:bigint>>, codes binary, weight double, bins binary")), n


def neighbours(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket that are at most NEXT apart, by their places."""
    left = [np.flatnonzero(bucket[d:] == bucket[:-d]) for d in range(1, min(NEXT, len(bucket) - 1) + 1)]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate([x + d for d, x in enumerate(left, 1)])


PAIR = "a binary, b binary, edge int, side int, bucket long"


def pair_rows(a, b, edge=None, side=None, bucket=None) -> pa.RecordBatch:
    none = [None] * len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(none if b is None else b, pa.binary()), pa.array(none if edge is None else edge, pa.int32()), pa.array(none if side is None else side, pa.int32()), pa.array(none if bucket is None else bucket, pa.int64())],
        ["a", "b", "edge", "side", "bucket"],
    )


def candidates(signatures: DataFrame) -> DataFrame:
    """Different pairs (a, b), a < b, of vertices that are neighbours in a bucket."""

    def run(batches):
        # rows come in order; the first NEXT rows of a partition also belong to the edge before it, the last to its own
        part, seen, bucket, v = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            own_bucket = batch.column("bucket").to_numpy()
            own_v = np.array(batch.column("v").to_pylist() + [None], object)[:-1]
            if seen < NEXT:
                k = min(NEXT - seen, len(own_v))
                yield pair_rows(own_v[:k], None, [part - 1] * k, list(range(seen, seen + k)), own_bucket[:k])
            carried = len(bucket)
            bucket, v = np.concatenate([bucket, own_bucket]), np.concatenate([v, own_v])
            left, right = neighbours(bucket)
            fresh = right >= carried  # pairs inside what was carried were already given
            if fresh.any():
                yield pair_rows(v[left[fresh]], v[right[fresh]])
            seen += len(own_v)
            bucket, v = bucket[-NEXT:], v[-NEXT:]
        yield pair_rows(v, None, [part] * len(v), list(range(-len(v), 0)), bucket)

    def meet(table: pa.Table) -> pa.Table:
        held = sorted(zip(table.column("side").to_pylist(), table.column("bucket").to_pylist(), table.column("a").to_pylist(), strict=True))
        tail, head = [x for x in held if x[0] < 0], [x for x in held if x[0] >= 0]
        both = [(x[2], y[2]) for x in tail for y in head if x[1] == y[1] and y[0] - x[0] <= NEXT]
        return pa.table({"a": pa.array([x for x, _ in both], pa.binary()), "b": pa.array([y for _, y in both], pa.binary())})

    order = ["bucket", "deep", "v"]
    placed = signatures.select("v", F.inline("places")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(placed.mapInArrow(run, PAIR))
    across = found.where("b is null").groupBy("edge").applyInArrow(meet, "a binary, b binary")
    pairs = found.where("b is not null").select("a", "b").union(across)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sketches (the last axis) agree as often as a link's would."""
    return ((one == two).mean(axis=-1) - 1 / 256) / (1 - 1 / 256) >= LEAST_ALIKE


def alike(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs whose sketches agree as often as a link's would."""

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SAMPLES) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(agreeing(one, two)))

    one, two = (signatures.select(F.col("v").alias(c), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Each pair (a, b) with the weighted Jaccard similarity of its texts; ``texts`` has v, text and codes."""

    def run(batches):
        def weights(text, codes):
            g, tf, _ = shingled([text])
            return g, tf * rarity(np.frombuffer(codes, np.uint8), n)

        for batch in batches:
            one, last, out = None, None, []
            for a, ta, ca, tb, cb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "ca", "tb", "cb")), strict=True):
                if a != last:
                    one, last = weights(ta, ca), a
                two = weights(tb, cb)
                _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
                both = np.minimum(one[1][i], two[1][j]).sum()
                out.append(float(both / max(one[1].sum() + two[1].sum() - both, 1e-300)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    left, right = (texts.select(F.col("v").alias(c), F.col("text").alias(f"t{c}"), F.col("codes").alias(f"c{c}")) for c in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "ca", "tb", "cb").mapInArrow(run, "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """v and the smallest vertex that links lead to from it, for each vertex with a link."""
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    labels = stored(edges.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("y")).select("v", F.lit(None).cast("binary").alias("old"), F.least("v", "y").alias("label")))
    while True:
        seen = edges.join(labels, F.col("y") == F.col("v")).groupBy("x").agg(F.min("label").alias("near"))
        nearer = labels.join(seen, F.col("v") == F.col("x")).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("j"), F.col("label").alias("further"))
        after = stored(nearer.join(jump, F.col("label") == F.col("j"), "left").select("v", "old", F.coalesce(F.least("label", "further"), "label").alias("label")))
        dropped(labels)
        labels = after
        if after.where("old != label").isEmpty():
            dropped(edges)
            return labels.select("v", "label")


HELD = "bucket long, cell long, low long, high long, rows array<struct<v:binary,part:bigint,text:binary,codes:binary>>"


def mixed_rows(signatures: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, v, part) of members of buckets that hold several components (``part``), or without labels several texts.

    Of a bucket of at most CELL members only those stay that may be a link of one of another part, by their weights and bins.
    """
    apart = (1 - THRESHOLD) / (1 + THRESHOLD) * (1 + 1e-9)  # the weights of a link differ by this share of their sum at most
    label = labels.select("v", F.xxhash64("label").alias("part")) if labels else signatures.select("v", F.xxhash64("v").alias("part"))
    own = stored(signatures.select("v", F.col("places.bucket").alias("buckets")).join(label, "v", "left").withColumn("part", F.coalesce("part", F.xxhash64("v"))))
    in_buckets = own.select("v", "part", F.explode("buckets").alias("bucket"))
    several = in_buckets.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low != high").select("bucket", "n")
    rows = stored(in_buckets.join(several, "bucket"))

    def awake(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            key = held.column("bucket").to_numpy()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else np.zeros(0, np.int64)
            if len(ends) > 1:
                yield stirred(held.slice(0, int(ends[-2])), ends[:-1])
                held = held.slice(int(ends[-2]))
        if held is not None and held.num_rows:
            yield stirred(held, np.array([held.num_rows]))

    def stirred(batch: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
        part, weight = batch.column("part").to_numpy(), batch.column("weight").to_numpy()
        bins = [np.frombuffer(x, np.uint8) for x in batch.column("bins").to_pylist()]
        stay = np.zeros(len(part), bool)
        for x, y in zip(np.append(0, ends[:-1]), ends, strict=True):
            w, p = weight[x:y], part[x:y]
            most = (w[:, None] + w[None, :]) * apart
            for i, j in zip(*np.nonzero(np.triu((p[:, None] != p[None, :]) & (np.abs(w[:, None] - w[None, :]) <= most), 1)), strict=True):
                if not (stay[x + i] and stay[x + j]) and differing(bins[x + i], bins[x + j]) <= most[i, j]:
                    stay[x + i] = stay[x + j] = True
        return batch.select(["bucket", "v", "part"]).filter(pa.array(stay))

    small = rows.where(F.col("n") <= CELL).join(signatures.select("v", "weight", "bins"), "v").select("bucket", "v", "part", "weight", "bins")
    small = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(awake, "bucket long, v binary, part long")
    found = stored(small.unionByName(rows.where(F.col("n") > CELL).select("bucket", "v", "part")))
    dropped(own, rows)
    return found


def cells(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, part, v, text, codes) in order; to a row, of one bucket CELL at most and CELL_BYTES of text, with their least and greatest part."""

    def run(batches):
        number, key, size, held = TaskContext.get().partitionId() << 40, None, 0, []

        def row():
            return pa.RecordBatch.from_pylist([{"bucket": key, "cell": number, "low": held[0]["part"], "high": held[-1]["part"], "rows": held}], kind)

        kind = pa.schema([*((c, pa.int64()) for c in ("bucket", "cell", "low", "high")), ("rows", pa.list_(pa.struct([("v", pa.binary()), ("part", pa.int64()), ("text", pa.binary()), ("codes", pa.binary())])))])
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["bucket"] != key or len(held) == CELL or size >= CELL_BYTES):
                    yield row()
                    number, size, held = number + 1, 0, []
                key, size = r["bucket"], size + len(r["text"])
                held.append({c: r[c] for c in ("v", "part", "text", "codes")})
        if held:
            yield row()

    order = ["bucket", "part", "v"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "text", "codes").mapInArrow(run, HELD))


def linked_cells(one: list[dict], two: list[dict], n: int, every: bool) -> list[tuple[bytes, bytes, float]]:
    """Links between members of two cells (or of one, given twice) that are of different parts: all of them, or a forest that connects the parts they connect."""
    both = one if one is two else [*one, *two]
    g, tf, doc = shingled([r["text"] for r in both])
    weight = tf * rarity(np.frombuffer(b"".join(r["codes"] for r in both), np.uint8), n)
    known, at = np.unique(g, return_inverse=True)
    begin = np.searchsorted(doc, np.arange(len(both) + 1))
    total = np.add.reduceat(np.append(weight, 0), begin[:-1])
    root = np.unique([r["part"] for r in both], return_inverse=True)[1].astype(np.int64)
    found, dense = [], np.zeros(len(known))
    for i in range(len(one)):
        others = np.arange(i + 1, len(both)) if one is two else np.arange(len(one), len(both))
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        mine = slice(begin[i], begin[i + 1])
        dense[at[mine]] = weight[mine]
        size = begin[others + 1] - begin[others]
        starts = np.cumsum(size) - size
        where = np.repeat(begin[others] - starts, size) + np.arange(size.sum())
        common = np.add.reduceat(np.minimum(dense[at[where]], weight[where]), starts)
        dense[at[mine]] = 0
        share = common / np.maximum(total[i] + total[others] - common, 1e-300)
        for j, x in zip(others[share >= THRESHOLD], share[share >= THRESHOLD], strict=True):
            if every or root[i] != root[j]:
                found.append((min(both[i]["v"], both[j]["v"]), max(both[i]["v"], both[j]["v"]), float(x)))
                if not every:
                    root[root == root[j]] = root[i]
    return found


def rest(rows: DataFrame, texts: DataFrame, n: int, every: bool = False) -> DataFrame:
    """Verified links (a, b, similarity) between ``rows`` (bucket, v, part) of one bucket and different parts; ``texts`` has v, text and codes.

    A bucket's cells meet each other in groups of their own, but for two of one part. A group gives no
    pairs but the links that connect its parts, or with ``every`` all links.
    """
    held = cells(rows.join(texts, "v"))

    def meet(table: pa.Table) -> pa.Table:
        found = []
        for a, b, one, two in zip(*(table.column(c).to_pylist() for c in ("cell_a", "cell_b", "rows_a", "rows_b")), strict=True):
            found += linked_cells(one, one if a == b else two, n, every)
        return pa.table({c: pa.array([x[k] for x in found], t) for k, (c, t) in enumerate((("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())))})

    one, two = (held.select("bucket", *(F.col(c).alias(f"{c}_{e}") for c in ("cell", "low", "high"))) for e in "ab")
    pairs = one.join(two, "bucket").where("cell_a <= cell_b and not (low_a = high_a and low_b = high_b and low_a = low_b)").select("cell_a", "cell_b")
    for e in "ab":
        pairs = pairs.join(held.select(*(F.col(c).alias(f"{c}_{e}") for c in ("cell", "rows"))), f"cell_{e}")
    found = pairs.groupBy("cell_a", "cell_b").applyInArrow(meet, "a binary, b binary, similarity double")
    found = stored(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    dropped(held)
    return found


def linked(docs: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between different texts, enough to connect every class, and v and label of the linked texts' components."""
    signatures, n = signed(docs)

    def texts_of(involved: DataFrame) -> DataFrame:
        return once(docs, mapped(involved)).join(involved, "v", "left_semi").dropDuplicates(["v"]).join(signatures.select("v", "codes"), "v")

    pairs = stored(alike(candidates(signatures), signatures))
    involved = pairs.select(F.col("a").alias("v")).distinct().union(pairs.select(F.col("b").alias("v")).distinct()).distinct()
    found = stored(verified(pairs, texts_of(involved), n).where(F.col("similarity") >= THRESHOLD))
    labels = components(found)
    left = mixed_rows(signatures, None if every else labels)
    if not left.isEmpty():
        more = rest(left, texts_of(left.select("v").distinct()), n, every)
        met = more.select(*(F.col(c).alias(f"v{c}") for c in "ab"))
        for c in "ab":
            met = met.join(labels.select(F.col("v").alias(f"v{c}"), F.col("label").alias(c)), f"v{c}", "left").withColumn(c, F.coalesce(c, f"v{c}"))
        wider = components(met.where("a != b").select("a", "b").distinct()).select(F.col("v").alias("label"), F.col("label").alias("wider"))
        ends = more.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti").select("v", F.col("v").alias("label"))
        after = stored(labels.unionByName(ends).join(wider, "label", "left").select("v", F.coalesce("wider", "label").alias("label")))
        dropped(labels)
        found, labels = found.unionByName(more.join(found, ["a", "b"], "left_anti")), after
    dropped(signatures, pairs, left)
    return found, labels


def links(docs: DataFrame, every: bool = False) -> DataFrame:
    """Verified links (a, b, similarity) between different texts: enough to connect every class, or ``every`` one of texts that share a bucket."""
    return linked(docs, every)[0]


def classes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, v, class_id (smallest id of the class), rows in the class, links of its text that were found, and class_key (the class)."""
    rows = keyed(docs).select("doc_id", "v")
    found, labels = linked(docs)
    degree = found.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("links"))
    known = labels.join(degree, "v")
    # texts first: copies of a text are counted before anything is shuffled, so classes are made of texts
    texts = rows.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    named = texts.join(known, "v", "left").select("v", "id", "n", F.coalesce("label", "v").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    whole = named.where("links > 0").groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    each = named.join(whole, "label", "left").select("v", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", "n").alias("class_size"), "links", F.col("label").alias("class_key"))
    found = rows.where("v is not null").join(each, "v").select("doc_id", "v", "class_id", "class_size", "links", "class_key")
    alone = rows.where("v is null").select("doc_id", "v", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("binary").alias("class_key"))
    return found.unionByName(alone)


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns; null texts stay."""
    stay = classes(docs).where("v is not null and doc_id <=> class_id").groupBy("class_key").agg(F.min(F.struct("v", "doc_id")).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.v").alias("v"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    held = own.where("key is not null").join(stay, F.col("key").eqNullSafe(F.col("v")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    first = F.row_number().over(Window.partitionBy("key", "id").orderBy(F.lit(1)))
    return held.withColumn("n", first).where("n = 1").select("row").unionByName(own.where("key is null").select("row")).select("row.*")
