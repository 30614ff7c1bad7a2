"""How many edits two texts are apart at least, from their runs of characters, and pairs of a group that may be closer than that.

An edit takes ``q`` runs of ``q`` characters out of a text and puts ``q`` in at most. So texts that are ``e`` edits apart differ in at most
``q * e`` runs on either side, counted as often as they occur. Hashing runs together can only hide a difference, so every bound here
stays one: a pair that is left out is further apart than asked.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np

#: From so many characters on: how long runs are, and at least how many bits a character. Longer texts of one language share more short runs.
KINDS = ((0, 3, 8), (300, 5, 8), (6000, 7, 32))
#: Words of bits compared at once.
WORDS = 1 << 15


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def runs(text: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of ``q`` characters and how often it came before; the same ones for any order of the runs."""
    c, n = text.astype(np.uint64), max(len(text) - q + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(q if n else 0):
        h = (h ^ c[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    if n:
        h.sort()
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        nth = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        h = (h + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    return h


def least(a: np.ndarray, b: np.ndarray, q: int) -> float:
    """How many edits it takes at least to turn a text with the runs ``a`` into one with ``b``."""
    both = np.sort(np.concatenate([a, b]))
    shared = np.count_nonzero(both[1:] == both[:-1])
    return (max(len(a), len(b)) - shared) / q


def bits(text: np.ndarray, q: int, size: int) -> np.ndarray:
    """The runs as a set of ``size`` bits, a power of two of 64 at least."""
    out = np.zeros(size, np.uint8)
    out[(runs(text, q) >> np.uint64(65 - size.bit_length())).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with alike; their distance stays."""
    if a == b:
        return "", ""
    x, y = code_points(a), code_points(b)
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    head = int(differ.argmax()) if differ.any() else n
    differ = x[len(x) - n + head :][::-1] != y[len(y) - n + head :][::-1]
    tail = int(differ.argmax()) if differ.any() else n - head
    return a[head : len(a) - tail], b[head : len(b) - tail]


def distance(a: str, b: str) -> int:
    """Edits between two texts, a column of the table at a time as the bits of two whole numbers: which of its steps go up, which down."""
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    points = code_points(a)
    at = {chr(c): int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") for c in np.unique(points).tolist()}
    every = (1 << len(a)) - 1
    up, down = every, 0
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        right, left = ((down | ~(xh | up)) << 1) | 1, (up & xh) << 1
        up, down = (left | ~(xv | right)) & every, right & xv
    return len(b) + up.bit_count() - down.bit_count()


def close(texts: list[str], share: float, wanted: Callable[[int, slice], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``texts``, sorted by length, that may be at most ``share`` of the longer one's length in edits apart.

    ``wanted(i, at)`` says which of the places ``at``, all behind ``i``, are to be compared with it.
    """
    if len(texts) < 2:
        return
    n = np.array([len(t) for t in texts])
    q, per = next((q, per) for at, q, per in reversed(KINDS) if n[0] >= at)
    size = 64
    while size < per * n[0]:
        size *= 2
    held = np.array([bits(code_points(t), q, size) for t in texts])
    _, same = np.unique(np.array([hash(t) for t in texts]), return_inverse=True)
    most = np.floor(share * n + 1e-6)  # edits, where this text is the longer one
    step = max(8, WORDS // held.shape[1])
    until = np.searchsorted(n * (1 - share), n + 1e-6, "right")
    for i, end in enumerate(until.tolist()):
        at = slice(i + 1, end)
        asked = wanted(i, at) & ((most[at] > 0) | (same[at] == same[i]))
        own = functools.cache(lambda r, t=texts[i]: runs(code_points(t), r))
        for a in range(i + 1, end, step):
            some = slice(a, min(end, a + step))
            ok = asked[a - i - 1 : a - i - 1 + step]
            if not ok.any():
                continue
            apart = np.bitwise_count(held[some] ^ held[i]).sum(axis=1, dtype=np.uint32)
            for j in (a + np.flatnonzero(ok & (apart <= 2 * q * most[some]))).tolist():
                if texts[i] == texts[j] or all(least(own(r), runs(code_points(texts[j]), r), r) <= most[j] for r in (q, q + 1)):
                    yield i, j
