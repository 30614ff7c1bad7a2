"""Feature selection from counts and products that the cluster adds up: what reaches the driver is a matrix of features.

* ``mutual_information``: joint counts of quantile bin and class.
* ``forward``: greedy least squares. The products of training and of validation rows are swept side by
  side, so a candidate's validation error follows from six numbers and no row is read again.
* ``thinned``: greedy elimination by rank correlation within blocks of related features.

Ranks are of the whole table: the line of values is cut into ranges at approximate quantiles, whose rows are
counted, so a task ranks one range and no task sorts a whole feature.

Defined results: null values and NaN are no values; a feature without any has information and correlation 0;
ties share a bin and an average rank; among equal scores the first name wins; an empty table gives no
steps and keeps nothing; columns that aren't named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from stratagrid.session import cut, dropped, stored

#: A matrix of so many columns squared is what the driver holds at most.
MAX_FEATURES = 2000
RANGES, FINE = 64, 256
#: More ranges where one would hold more rows than this, and values that a block of rows has, about.
RANGE_ROWS, BLOCK_CELLS = 1 << 20, 1 << 22


def positions(counts: DataFrame) -> DataFrame:
    """For each (feature, value, n): ``below``, the rows with smaller values, and ``total``, all of the feature."""
    cuts = counts.groupBy("feature").agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    cell = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    held = counts.join(cuts, "feature").withColumn("cell", cell).drop("cuts")
    cells = held.groupBy("feature", "cell").agg(F.sum("n").alias("inside"))
    before = Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    cells = cells.select("feature", "cell", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"), F.sum("inside").over(Window.partitionBy("feature")).alias("total"))
    within = Window.partitionBy("feature", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return held.join(cells, ["feature", "cell"]).select("feature", "value", "n", (F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("below"), "total")


def borders(rows: DataFrame, n: int, bins: int) -> np.ndarray:
    """For each of the columns c0 to c(n - 1) the values above which its 2nd and further bins begin; exact, in order."""
    cuts, offsets, total, _, _ = ranged(rows, n, FINE)
    wanted = [[-(-k * int(t) // bins) for k in range(1, bins)] if t else [] for t in total]  # a bin begins above the value of this place
    cells = [[int(np.searchsorted(offsets[i], w, side="left")) - 1 for w in wanted[i]] for i in range(n)]

    def pick(batches):
        for batch in batches:
            x, out = numbers(batch, n), []
            for i in range(n):
                v = x[~np.isnan(x[:, i]), i]
                at = np.searchsorted(cuts[i], v)
                own = np.isin(at, cells[i])
                values, first, counts = np.unique(v[own], return_index=True, return_counts=True)
                out.append((np.full(len(values), i, np.int32), at[own][first].astype(np.int32), values, counts.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["i", "cell", "value", "n"])

    near = rows.mapInArrow(pick, "i int, cell int, value double, n long").groupBy("i", "cell", "value").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("i", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    asked = rows.sparkSession.createDataFrame([(i, c, k, w - int(offsets[i][c])) for i in range(n) for k, (c, w) in enumerate(zip(cells[i], wanted[i], strict=True))], "i int, cell int, k int, place long")
    held = near.withColumn("upto", before).join(F.broadcast(asked), ["i", "cell"]).where("upto >= place").groupBy("i", "k").agg(F.min("value").alias("value")).collect()
    out = np.full((n, bins - 1), np.inf)
    for r in held:
        out[r["i"], r["k"]] = r["value"]
    return out


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, n and mi (nats) between the feature's quantile bin and the class, over rows that have both.

    A bin's border is a value of a known place, so only the ranges that hold one are looked into; no row is shuffled.
    """
    f, kind = len(features), df.schema[label].dataType
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = stored(df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), *(number(c).alias(f"c{i}") for i, c in enumerate(features))))
    edges = borders(rows, f, bins)

    def count(batches):
        for batch in batches:
            x, code = numbers(batch, f), batch.column("label").dictionary_encode()
            which, out = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), []
            for i in range(f):
                own = ~np.isnan(x[:, i])
                cell, n = np.unique(which[own] * bins + np.searchsorted(edges[i], x[own, i]), return_counts=True)
                out.append((np.full(len(cell), i, np.int32), (cell % bins).astype(np.int32), cell // bins, n.astype(np.int64)))
            i, at, name, n = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(at), code.dictionary.take(pa.array(name)), pa.array(n)], ["i", "bin", "label", "n"])

    fields = StructType([StructField("i", IntegerType()), StructField("bin", IntegerType()), StructField("label", kind), StructField("n", LongType())])
    cells = cut(rows.mapInArrow(count, fields).groupBy("i", "bin", "label").agg(F.sum("n").alias("n")))
    dropped(rows)
    of = lambda *by: F.sum("n").over(Window.partitionBy("i", *by))  # noqa: E731  bins times classes rows
    cells = cells.withColumns({"total": of(), "x": of("bin"), "y": of("label")})
    share = F.col("n") / F.col("total")
    found = cells.groupBy("i").agg(F.sum("n").alias("n"), F.sum(share * F.ln(F.col("n") * F.col("total") / (F.col("x") * F.col("y")).cast("double"))).alias("mi"))
    every = df.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    return every.join(found, "i", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))


def squeezed(x: np.ndarray) -> bytes:
    """Numbers with their lowest bytes first, then their next ones, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def opened(held: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(held[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(held[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def numbers(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Columns c0 to c(n - 1), NaN for no value."""
    return np.column_stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(n)])


def ranged(rows: DataFrame, n: int, least: int = RANGES) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the columns c0 to c(n - 1): cuts, and the rows below each range; and the rows that have a value, one below 0, and 0."""
    ranges = max(least, math.ceil(rows.count() / RANGE_ROWS))
    found = rows.agg(*(F.percentile_approx(f"c{i}", [k / ranges for k in range(1, ranges)], 10 * ranges) for i in range(n))).first()
    cuts = [np.unique(np.array(c or [], float)) for c in found]

    def count(batches):
        held = np.zeros((n, ranges + 2), np.int64)
        for batch in batches:
            x = numbers(batch, n)
            for i in range(n):
                v = x[~np.isnan(x[:, i]), i]
                held[i, : len(cuts[i]) + 1] += np.bincount(np.searchsorted(cuts[i], v), minlength=len(cuts[i]) + 1)
                held[i, -2:] += ((v < 0).sum(), (v == 0).sum())
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(held.ravel()[cell])], ["cell", "n"])

    total = np.zeros((n, ranges + 2), np.int64)
    for r in rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total.ravel()[r["cell"]] = r["n"]
    inside = total[:, :-2]
    return cuts, np.cumsum(inside, axis=1) - inside, inside.sum(axis=1), total[:, -2], total[:, -1]


def exact(product, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``product`` of whole numbers below 2^35 of at most 2^16 rows, as three parts that floats hold exactly: of 2^34, of 2^17 and of 1."""
    (a, b), (c, d) = ((z >> 17, z & 0x1FFFF) for z in (x, y))
    a, b, c, d = (z.astype(float) for z in (a, b, c, d))
    return np.stack([product(a, c), product(a, d) + product(b, c), product(b, d)]).astype(np.int64)


def rank_sums(df: DataFrame, features: list[str], outcome: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact sums over rows of products of centred ranks (twice the average rank less the middle): of each
    feature and the outcome over the rows that have both (x y, x x, y y), the number of these rows, and
    those of all pairs of features, in which no value counts as 0.

    Rows are cut into blocks. A block sends each range of a column the values it has there, with their counts and, packed, the rows
    they are of; the range ranks them and sends them back. So a value moves twice, in a few bytes, and no row is joined.
    """
    if len(features) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    f = len(features)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = stored(df.select(*(number(c).alias(f"c{i}") for i, c in enumerate([*features, *([outcome] if outcome else [])]))))
    of: list[int] = []
    width = f
    source = rows
    if outcome:
        # features that are there in the same rows share the outcome's ranks: they have equal sums of the rows' hashes
        row = F.xxhash64(*rows.columns)
        sums = [F.sum(F.when(F.col(f"c{i}").isNotNull(), part)) for i in range(f) for part in (F.shiftrightunsigned(row, 33), row.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(1))]
        held = rows.agg(*sums).first()
        kinds: dict = {}
        of = [f + kinds.setdefault(tuple(held[3 * i : 3 * i + 3]), len(kinds)) for i in range(f)]
        width = f + len(kinds)
        source = rows.select(*(f"c{i}" for i in range(f)), *(F.when(F.col(f"c{of.index(k)}").isNotNull(), F.col(f"c{f}")).alias(f"c{k}") for k in range(f, width)))
    cuts, offsets, total, negative, zero = ranged(source, width)
    size = max(1, min(1 << 16, BLOCK_CELLS // width))

    def send(batches):
        part, seen, wait, have = TaskContext.get().partitionId(), 0, [], 0

        def block(x: np.ndarray) -> pa.RecordBatch:
            out = []
            for i in range(width):
                at = np.flatnonzero(~np.isnan(x[:, i])).astype(np.uint16)
                cell = np.searchsorted(cuts[i], x[at, i])
                order = np.argsort(cell, kind="stable")
                ends = np.searchsorted(cell[order], np.arange(len(cuts[i]) + 2))
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if b > a or i == k == 0:
                        own = at[order[a:b]]
                        values, which, counts = np.unique(x[own, i], return_inverse=True, return_counts=True)
                        out.append((i, k, (part << 32) + seen, len(x), squeezed(np.diff(own, prepend=np.uint16(0))), squeezed(which.astype(np.uint16)), squeezed(values), squeezed(counts.astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_sent, strict=True)], names_sent)

        for batch in batches:
            wait.append(numbers(batch, width))
            have += len(wait[-1])
            while have >= size:
                x = np.concatenate(wait)
                yield block(x[:size])
                wait, have, seen = [x[size:]], have - size, seen + 1
        if have:
            yield block(np.concatenate(wait))

    names_sent, kinds_sent = ["i", "cell", "block", "size", "at", "which", "vals", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

    def resolve(table: pa.Table) -> pa.Table:
        i, cell = table.column("i")[0].as_py(), table.column("cell")[0].as_py()
        values = [opened(x, np.float64) for x in table.column("vals").to_pylist()]
        counts = np.concatenate([opened(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        own, which = np.unique(np.concatenate(values), return_inverse=True)
        n = np.zeros(len(own), np.int64)
        np.add.at(n, which, counts)
        rank = (2 * (offsets[i, cell] + np.cumsum(n) - n) + n - total[i])[which]
        ends = np.cumsum([0, *map(len, values)])
        sent = [squeezed(rank[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([*(table.column(c) for c in ("block", "size", "i", "at", "which")), pa.array(sent, pa.binary())], ["block", "size", "i", "at", "which", "ranks"])

    def multiply(table: pa.Table) -> pa.Table:
        x = np.zeros((table.column("size")[0].as_py(), width), np.int64)
        there = np.zeros(x.shape, bool)
        for i, at, which, ranks in zip(*(table.column(c).to_pylist() for c in ("i", "at", "which", "ranks")), strict=True):
            at = np.cumsum(opened(at, np.uint16), dtype=np.int64)
            x[at, i], there[at, i] = opened(ranks, np.int64)[opened(which, np.uint16)], True
        # with 0 where no value is: values above and below 0 move apart by the number of these rows
        n, neg, nil = everything - total[:f], negative[:f], zero[:f]
        place = x[:, :f] + total[:f]
        filled = np.where(there[:, :f], x[:, :f] + n * ((place > 2 * neg + nil).astype(np.int64) - (place < 2 * neg)), 2 * neg + nil - total[:f])
        along = lambda p, q: (p * q).sum(axis=0)
        pairs = [exact(along, x[:, :f], x[:, of]), exact(along, x[:, :f], x[:, :f]), exact(along, x[:, of], x[:, of])] if outcome else []
        parts = np.concatenate([*pairs, exact(lambda p, q: p.T @ q, filled, filled).reshape(3, -1)], axis=1)
        return pa.table({"parts": pa.array([parts.tobytes()], pa.binary())})

    def add(batches):
        held = np.zeros(3 * cells, np.int64)
        for batch in batches:
            for x in batch.column("parts").to_pylist():
                held += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), *(pa.array(x) for x in held.reshape(3, cells))], ["cell", "high", "mid", "low"])

    everything, cells = rows.count(), f * f + (3 * f if outcome else 0)
    blocks = source.mapInArrow(send, "i int, cell int, block long, size int, at binary, which binary, vals binary, counts binary").groupBy("i", "cell").applyInArrow(resolve, "block long, size int, i int, at binary, which binary, ranks binary")
    parts = blocks.groupBy("block").applyInArrow(multiply, "parts binary").mapInArrow(add, "cell long, high long, mid long, low long")
    whole = np.zeros(cells, object)
    for r in parts.groupBy("cell").agg(*(F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("high", "mid", "low"))).collect():
        whole[r["cell"]] = (int(r["high"]) << 34) + (int(r["mid"]) << 17) + int(r["low"])
    dropped(rows)
    found = whole.astype(float)
    with_outcome = total[of] if outcome else np.zeros(f, np.int64)
    return found[: cells - f * f].reshape(-1, f), with_outcome, found[cells - f * f :].reshape(f, f)


def correlated(sums: np.ndarray) -> np.ndarray:
    scale = np.sqrt(sums[1]) * np.sqrt(sums[2])
    return np.divide(sums[0], scale, out=np.zeros(sums.shape[1]), where=scale > 0)


def pooled_ic(df: DataFrame, features: list[str], outcome: str, key: list[str]) -> DataFrame:
    """feature, n and ic: the rank correlation with the outcome over all rows that have both; 0 where one doesn't vary."""
    sums, n, _ = rank_sums(df.where(F.col(outcome).isNotNull() & ~F.isnan(outcome)), features, outcome)
    rows = [(x, int(k), float(ic)) for x, k, ic in zip(features, n, correlated(sums), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, n long, ic double")


def products(df: DataFrame, columns: list[str], centre: np.ndarray | None = None, by: Column | None = None) -> dict[bool, np.ndarray]:
    """Sums of products of all pairs of columns less ``centre`` (columns and a 1, if that is None), for rows of either truth of ``by``.

    A task adds up its own rows as a matrix product and hands on one row a pair of columns.
    """
    if len(columns) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    width = len(columns) + (centre is None)

    def run(batches):
        held = np.zeros((2, width, width))
        for batch in batches:
            side = batch.column("side").to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))])
            x = np.column_stack([x, np.ones(len(x))]) if centre is None else x - centre
            for k in (0, 1):
                held[k] += x[side == bool(k)].T @ x[side == bool(k)]
        cell = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(held.ravel()[cell])], ["cell", "total"])

    rows = df.select((F.lit(True) if by is None else by).alias("side"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    cells = rows.mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros((2, width, width))
    out.ravel()[cells.column("cell").to_numpy()] = cells.column("total").to_numpy()
    return {False: out[0], True: out[1]}


def swept(train: np.ndarray, valid: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of what column ``p`` leaves of each column, by the training rows' regression on it."""
    share = train[:, p] / train[p, p]
    inner = valid - np.outer(share, valid[p]) - np.outer(valid[:, p], share) + np.outer(share, share) * valid[p, p]
    return train - np.outer(share, train[p]), inner


def forward(df: DataFrame, features: list[str], outcome: str, train: Column, k: int = 50) -> DataFrame:
    """step, feature and score: each step adds the feature with which least squares, fitted on the rows of ``train``, explain most of the others' variance.

    A feature that those before explain (but for 1e-10 of its variance) is never added. ``score`` is one
    less the validation rows' squared error by that of the training mean.
    """
    columns = [*features, outcome]
    rows = df.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns))
    raw = products(rows, columns, None, train)[True]
    steps: list[tuple[int, str, float]] = []
    if raw[-1, -1]:
        held = products(rows, columns, raw[-1, :-1] / raw[-1, -1], train)
        a, b = held[True], held[False]
        full, total, y = a.diagonal().copy(), b[-1, -1], len(features)
        left = set(range(len(features)))
        while left and len(steps) < k and total > 0:
            free = [i for i in sorted(left, key=features.__getitem__) if a[i, i] > 1e-10 * full[i]]
            weight = [a[i, y] / a[i, i] for i in free]
            score = [1 - (b[y, y] - 2 * w * b[i, y] + w * w * b[i, i]) / total for i, w in zip(free, weight, strict=True)]
            if not free:
                break
            best = int(np.argmax(score))
            steps.append((len(steps) + 1, features[free[best]], float(score[best])))
            left.remove(free[best])
            a, b = swept(a, b, free[best])
    return df.sparkSession.createDataFrame(steps, "step int, feature string, score double")


def by_scale(m: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.outer(m.diagonal(), m.diagonal()))
    return np.divide(m, scale, out=np.zeros_like(m), where=scale > 0)


def rank_correlations(df: DataFrame, features: list[str], key: list[str]) -> np.ndarray:
    """Rank correlations of all pairs of features over all rows; no value counts as 0."""
    return by_scale(rank_sums(df, features, None)[2])


def thinned(df: DataFrame, features: list[str], outcome: str, key: list[str], blocks: dict[str, str] | None = None, least: float = 0.01, most: float = 0.85) -> DataFrame:
    """feature, ic, place and kept, of the features whose correlation with the outcome is above ``least``.

    In order of falling correlation (``place``) a feature stays unless its rank correlation with one that
    stayed in the same block is ``most`` or more; ``blocks`` names each feature's block (one for all without it).
    """
    sums, _, m = rank_sums(df.where(F.col(outcome).isNotNull() & ~F.isnan(outcome)), features, outcome)
    found, near = correlated(sums), np.abs(by_scale(m))
    order = sorted((i for i, ic in enumerate(found) if abs(ic) > least), key=lambda i: (-round(abs(found[i]), 12), features[i]))
    rows, kept = [], []
    block = [(blocks or {}).get(f, "") for f in features]
    for place, i in enumerate(order, 1):
        stays = all(near[i, j] < most for j in kept if block[j] == block[i])
        kept += [i] * stays
        rows.append((features[i], float(found[i]), place, bool(stays)))
    return df.sparkSession.createDataFrame(rows, "feature string, ic double, place int, kept boolean")
