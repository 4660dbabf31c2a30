"""Hashes of words and of runs of words for whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}
#: Bytes that are hashed at a time, so that the arrays of 64-bit numbers beside them stay small.
CHUNK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes one after the other, and the bounds of the texts; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    raw = texts.cast(pa.binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = raw.buffers()[2]
    b = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return b, bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts with about `size` bytes together, one text at least."""
    at = 0
    while at < len(bounds) - 1:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, upto
        at = upto


def words(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other, and each text's first word."""
    solid = ~_SPACE[b]
    head = np.zeros(len(b) + 1, bool)
    head[bounds] = True
    before = np.concatenate([[False], solid[:-1]]) if len(b) else solid
    after = np.concatenate([solid[1:], [False]]) if len(b) else solid
    starts = np.flatnonzero(solid & (~before | head[:-1]))
    ends = np.flatnonzero(solid & (~after | head[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64 bits for each word, from a polynomial in its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[b] if lower else b] * powers(_BASE, len(b)), out=upto[1:])
    return mixed((upto[ends] - upto[starts]) * powers(_INVERSE, len(b) + 1)[starts])


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, whether or not they are of one text."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    factor = powers(_STEP, n)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * factor[k]
    return mixed(out)


def sequence(h: np.ndarray) -> np.uint64:
    """A hash of a whole sequence; of another kind than those of runs()."""
    return mixed(np.array([(h * powers(_STEP, len(h))).sum() + np.uint64(len(h))], np.uint64))[0]
