"""Whitening of embeddings by singular values that are merged up a tree.

Each task keeps, of its rows, the count, the exact sums and the factor S V^T of the centred rows, with all
singular values. Two such summaries become one by stacking both factors and one more row,
sqrt(n m / (n + m)) times the difference of the means, and decomposing the stack again: the factor's square
is the scatter of all rows, so nothing is lost. Tasks' summaries are merged by FAN at a time in the shared
folder's tables until one is left; a summary has at most as many rows as the vectors have components, so
neither a merge nor the driver ever holds more than FAN squares of that length.

Numbers are whole: floor(SCALE * c) + SHIFT. Decompositions are of the numbers less SHIFT, which are small,
and less their mean.

Defined results: rows without a usable vector (see ``vectors``) go; repeated rows count each; null ids stay;
an empty table gives an empty table; a component without variance gives null as ``whitened`` and isn't
part of ``identity_error``; a deviation beyond a long is null; other columns of the input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.llm.vectors import dense, slices, whole
from stratagrid.session import dropped, stored

SCALE, SHIFT, COMPONENTS, FAN = 64, 1_000_000, 32, 8
SUMMARY = "part int, n long, sums binary, factor binary"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Summary:
    """Of some rows: how many, their sums (whole or not), and S V^T of the centred rows."""

    n: int
    sums: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        sums = rows.sum(axis=0)
        return cls(len(rows), sums, factored(rows - sums / len(rows)))

    def merged(self, other: Summary) -> Summary:
        if len(self.sums) != len(other.sums):
            raise ValueError("vectors differ in length")
        n, m = self.n, other.n
        # the numerator is exact where sums are whole
        apart = (self.sums.astype(object) * m - other.sums.astype(object) * n).astype(np.float64) / (n * m)
        return Summary(n + m, self.sums + other.sums, factored(np.vstack([self.factor, other.factor, math.sqrt(n * m / (n + m)) * apart])))

    def row(self, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([self.n]), pa.array([self.sums.tobytes()]), pa.array([self.factor.tobytes()])], ["part", "n", "sums", "factor"])


def factored(rows: np.ndarray) -> np.ndarray:
    """S V^T of ``rows``: all singular values, none dropped."""
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def summary(df: DataFrame, numbers, kind: type) -> Summary | None:
    """One summary of all rows; ``numbers`` turns a batch into a matrix, ``kind`` is the sums' type."""

    def collected(batches):
        held = None
        for batch in batches:
            for part in slices(batch, "embedding"):
                rows = numbers(part)
                if len(rows):
                    held = Summary.of(rows) if held is None else held.merged(Summary.of(rows))
        if held is not None:
            yield held.row(TaskContext.get().partitionId())

    def opened(row) -> Summary:
        sums = np.frombuffer(row["sums"], kind)
        return Summary(row["n"], sums, np.frombuffer(row["factor"], np.float64).reshape(-1, len(sums)))

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        held = opened(rows[0])
        for r in rows[1:]:
            held = held.merged(opened(r))
        return pa.Table.from_batches([held.row(rows[0]["part"] // FAN)])

    level = stored(df.select("embedding").mapInArrow(collected, SUMMARY))
    most = level.agg(F.max("part")).first()[0]
    while most:
        above = stored(level.groupBy((F.col("part") / FAN).cast("int").alias("key")).applyInArrow(merge, SUMMARY))
        dropped(level)
        level, most = above, most // FAN
    last = level.collect()
    dropped(level)
    return opened(last[0]) if last else None


@dataclass
class Model:
    """Count, exact sums, and eigenvalues and unit eigenvectors (rows) of the covariance, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Rows by component; a component without variance gives nan."""
        mean = np.array([int(s) - self.n * SHIFT for s in self.sums], dtype=object) / self.n
        flat = self.values[:components] <= self.values[0] * (len(self.sums) * np.finfo(float).eps) ** 2
        over = np.sqrt(np.where(flat, np.nan, self.values[:components]))
        return ((x - SHIFT) - mean.astype(np.float64)) @ self.axes[:components].T / over


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    return whole(dense(batch.column("embedding"))[1], SCALE)


def fit(df: DataFrame) -> Model | None:
    """The whitening of all rows, or None without rows."""
    held = summary(df, numbers, np.int64)
    if held is None:
        return None
    _, s, v = np.linalg.svd(held.factor, full_matrices=True)
    v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
    values = np.zeros(len(v))
    values[: len(s)] = s * s / held.n
    return Model(held.n, held.sums + held.n * SHIFT, values, v)


def identity_error(df: DataFrame, model: Model, components: int) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured on all rows."""

    def run(batch):
        values = dense(batch.column("embedding"))[1]
        if not len(values):
            return values
        w = model.whitened(whole(values, SCALE, SHIFT), components)
        return w[:, ~np.isnan(w[0])]

    if not model.values[0]:
        return 0.0
    held = summary(df, run, np.float64)
    return float(np.abs(held.factor.T @ held.factor / held.n - np.eye(len(held.sums))).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - sums)^2, exact; None beyond a long."""
    bound = max(abs(n * int(x.max()) - int(sums.min())), abs(n * int(x.min()) - int(sums.max())))
    if bound * bound * x.shape[1] < 1 << 62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def whitened(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained and identity_error."""
    model = fit(df)
    if model is None:
        return df.sparkSession.createDataFrame([], WHITENED)
    k = min(components, len(model.sums))
    error, share = identity_error(df, model, k), model.values[:k] / (model.values.sum() or 1.0)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "embedding", 1 << 17):  # each vector makes k rows
                keep, values = dense(part.column("embedding"))
                if not len(keep):
                    continue
                x = whole(values, SCALE, SHIFT)
                rows = len(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(np.repeat(keep, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, model.n)),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(model.whitened(x, k).ravel(), from_pandas=True),
                        pa.array(np.tile(share, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return df.select("vec_id", "embedding").mapInArrow(run, WHITENED)
