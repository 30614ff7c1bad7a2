"""Vector codes: each quarter of a vector becomes the number of its nearest entry in a codebook.

Components are whole numbers. Codebooks start from the rows of the smallest ids and go through a fixed
number of rounds, in which each entry becomes the floored mean of the parts nearest to it. The nearest
entry is found in a ball tree over the entries of a part position. A ball is entered if the distance to
its centre, rounded down, less its radius, rounded up, isn't above the best distance so far; equality
enters, so that of entries equally near the one with the lower index is found. Distances between parts
and entries are whole numbers: doubles hold them exactly below 2^53, beyond that 64-bit integers are used,
and the winner's distance is computed once more in integers.

A round is one pass over the table. A task adds up its own parts by entry, so what is exchanged is at
most a row a task and codebook component. The codebooks (256 entries of one vector's length in all) are
all that reaches the driver and all that is sent to tasks.

Defined results: rows without a usable vector (see ``vectors``) go; repeated rows and repeated ids count
each; a null id comes after all others; fewer than 256 rows give as many entries; entries that no part is
nearest to stay; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.vectors import dense, slices, whole

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 4, 256, 4, 1024, 16


def above_root(x: int) -> int:
    """The smallest whole number whose square is at least ``x``."""
    root = math.isqrt(x)
    return root + (root * root < x)


def below_root(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose squares are at most ``x``."""
    root = np.sqrt(x.astype(np.float64)).astype(np.int64)
    return root - (root * root > x)


def squares(q: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``q`` to each of ``entries``, exact."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * q.shape[1] * most * most
    if bound >= 1 << 62:
        raise ValueError("components too large for exact squared distances")
    if bound >= 1 << 53:
        return np.stack([((q - e) ** 2).sum(axis=1) for e in entries], axis=1)
    a, b = q.astype(np.float64), entries.astype(np.float64)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)


class Ball:
    """A centre, a radius that covers all entries below it, and two smaller balls or the entries."""

    def __init__(self, entries: np.ndarray, index: np.ndarray):
        self.centre = np.rint(entries.mean(axis=0)).astype(np.int64)
        away = squares(entries, self.centre[None])[:, 0]
        self.radius = above_root(int(away.max()))
        self.balls: tuple[Ball, ...] = ()
        if len(index) <= LEAF:
            at = np.argsort(index)
            self.entries, self.index = entries[at], index[at]
            return
        one = entries[away.argmax()]
        other = entries[squares(entries, one[None])[:, 0].argmax()]
        toward = squares(entries, np.stack([one, other]))
        order = np.argsort(toward[:, 0] - toward[:, 1], kind="stable")
        self.balls = tuple(Ball(entries[half], index[half]) for half in np.array_split(order, 2))


class Nearest:
    """Exact nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        _, first = np.unique(entries, axis=0, return_index=True)  # of equal entries only the first can win
        self.root = Ball(entries[first], first)

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        self.q, self.best, self.who = q, np.full(len(q), np.iinfo(np.int64).max), np.full(len(q), len(self.entries))
        self.visits = 0
        if len(q):
            self._enter(self.root, np.arange(len(q)))
        return self.who, ((q - self.entries[self.who]) ** 2).sum(axis=1) if len(q) else self.best

    def _enter(self, ball: Ball, rows: np.ndarray) -> None:
        if not ball.balls:
            self.visits += len(rows)
            d = squares(self.q[rows], ball.entries)
            at = d.argmin(axis=1)
            d, who = d[np.arange(len(rows)), at], ball.index[at]
            better = (d < self.best[rows]) | ((d == self.best[rows]) & (who < self.who[rows]))
            self.best[rows[better]], self.who[rows[better]] = d[better], who[better]
            return
        away = squares(self.q[rows], np.stack([b.centre for b in ball.balls]))
        least = np.maximum(0, below_root(away) - np.array([b.radius for b in ball.balls])) ** 2
        left = away[:, 0] <= away[:, 1]
        for near, far, group in ((0, 1, left), (1, 0, ~left)):
            for k in (near, far):
                inside = group & (least[:, k] <= self.best[rows])
                if inside.any():
                    self._enter(ball.balls[k], rows[inside])


def parted(values: np.ndarray) -> np.ndarray:
    """Rows by part by position, as whole numbers."""
    if values.shape[1] % PARTS:
        raise ValueError(f"vectors don't cut into {PARTS} equal parts")
    return whole(values, SCALE).reshape(len(values), PARTS, -1)


def first_books(df: DataFrame) -> np.ndarray:
    """Part by entry by position: the parts of the rows with the smallest ids."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "embedding"):
                keep, values = dense(part.column("embedding"))
                if len(keep):
                    x = parted(values).reshape(len(keep), -1)
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(keep)), pa.array(list(x), pa.list_(pa.int64()))], ["vec_id", "x"])

    rows = df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x array<long>")
    rows = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    if len({len(r["x"]) for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    x = np.array([r["x"] for r in rows], np.int64)
    return x.reshape(len(rows), PARTS, -1).transpose(1, 0, 2) if len(rows) else x


def found(part: pa.RecordBatch, trees: list[Nearest]):
    """Rows kept, their parts, and index and distance of each part's nearest entry."""
    keep, values = dense(part.column("embedding"))
    if not len(keep):
        return keep, None, None, None
    x = parted(values)
    if x.shape[2] != trees[0].entries.shape[1]:
        raise ValueError("vectors differ in length")
    who, error = zip(*(tree.find(x[:, p]) for p, tree in enumerate(trees)), strict=True)
    return keep, x, np.stack(who, axis=1), np.stack(error, axis=1)


def next_books(df: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    k, width = books.shape[1], books.shape[2]

    def run(batches):
        trees = [Nearest(b) for b in books]
        sums = np.zeros((PARTS, k, width + 1), np.int64)  # the last column counts
        for batch in batches:
            for part in slices(batch, "embedding"):
                keep, x, who, _ = found(part, trees)
                for p in range(PARTS if len(keep) else 0):
                    order = np.argsort(who[:, p], kind="stable")
                    entry, at = np.unique(who[order, p], return_index=True)
                    sums[p, entry, :width] += np.add.reduceat(x[order, p], at, axis=0)
                    sums[p, entry, width] += np.diff(np.append(at, len(order)))
        cell = np.flatnonzero(np.repeat(sums[..., width] > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(sums.ravel()[cell])], ["cell", "total"])

    cells = df.select("embedding").mapInArrow(run, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((PARTS, k, width + 1), np.int64)
    sums.ravel()[cells.column("cell").to_numpy()] = cells.column("total").to_numpy()
    count = sums[..., width:]
    return np.where(count > 0, sums[..., :width] // np.maximum(count, 1), books)


def codebooks(df: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Part by entry by position, after all rounds."""
    books = first_books(df)
    for _ in range(rounds if books.size else 0):
        books = next_books(df, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(df: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each row."""

    def run(batches):
        trees = [Nearest(b) for b in books] if books.size else []
        hexes = np.array([f"{i:02x}" for i in range(ENTRIES)], dtype=object)
        for batch in batches if trees else ():
            for part in slices(batch, "embedding"):
                keep, _, who, error = found(part, trees)
                if len(keep):
                    at = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), part.column("label").take(at), pa.array(hexes[who].sum(axis=1), pa.string()), pa.array(error.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return df.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, "vec_id long, label long, code string, error long")


def compressed(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row.

    Labels' errors are added up in the tasks first and joined back, so a hot label is one small row
    on one side and can be split on the other.
    """
    books = codebooks(df)
    rows = coded(df, books)
    labels = coded(df, books).groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
