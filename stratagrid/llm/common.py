"""Words, hashes and batches that the corpus operators share.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, unchanged; ``bytes.split()`` cuts at
exactly these. Hashes are 64-bit, fixed over processes and runs, so a task that is run again gives
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task turns into words at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of ``column``, so that word lists stay small."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that every bit depends on all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(h: np.ndarray, k: int, base: int = _P) -> np.ndarray:
    """The hash of every run of ``k`` neighbours in ``h``, in log2(k) passes; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, length, done, have = h, 1, None, 0
    while True:
        if k & length:
            if done is None:
                done, have = power, length
            else:  # the part so far stands first
                n = min(len(done), len(power) - have)
                done = done[:n] * np.uint64(pow(base, length, 1 << 64)) + power[have : have + n]
                have += length
        if have == k:
            return mixed(done[: len(h) - k + 1])
        n = len(power) - length
        power = power[:n] * np.uint64(pow(base, length, 1 << 64)) + power[length : length + n]
        length *= 2


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive groups begins, and the total at the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def windows(h: np.ndarray, counts: np.ndarray, k: int, base: int = _P) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start (in ``h``) of each run of ``k`` words that stays in one document."""
    g = rolled(h, k, base)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[: len(g)] == doc[k - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[at], doc[at], at


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` that starts at one of ``at``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold the largest; the first byte tells how many."""
    size = np.min_scalar_type(int(numbers.max())).itemsize if len(numbers) else 1
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"<u{held[0]}", offset=1)


def planes(rising: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, first all their lowest bytes, and so on: the highest are zeros, which compress."""
    return np.diff(rising, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(held: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(held: bytes) -> bytes:
    """Compressed, behind its length: packets are small in memory and in the exchange."""
    return len(held).to_bytes(4, "little") + pa.compress(held, codec="zstd", asbytes=True)


def opened(held: bytes) -> bytes:
    return pa.decompress(held[4:], int.from_bytes(held[:4], "little"), codec="zstd", asbytes=True)
