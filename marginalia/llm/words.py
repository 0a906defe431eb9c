"""Words and shingles of whole texts as 64-bit hashes, computed with array operations.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts come as bytes, so that
these six bytes and the letters A-Z are the only ones treated specially.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 19)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text the index of its first word
    (one more entry closes the last text)."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_UNBASE, len(buf))[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _STEP[63])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` neighbouring words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _STEP[k]
    return mix(total)


def shingle_sets(texts: list[bytes], size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted hashes. A text with fewer words gives its
    whole sequence as one; a text without words gives an empty array."""
    hashes, first = word_hashes(texts)
    runs = windows(hashes, size)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            short = windows(hashes[a:b], int(b - a))
            yield mix(short + np.uint64(b - a) * _STEP[62])
        else:
            yield runs[:0]


def text_blocks(ids: list, texts: list, limit: int = 1 << 18) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in blocks of about ``limit`` bytes, so that arrays over a block stay small.
    A longer text is a block of its own; a null text is empty."""
    ids_now: list = []
    texts_now: list[bytes] = []
    held = 0
    for i, t in zip(ids, texts):
        t = t or b""
        if texts_now and held + len(t) > limit:
            yield ids_now, texts_now
            ids_now, texts_now, held = [], [], 0
        ids_now.append(i)
        texts_now.append(t)
        held += len(t)
    if texts_now:
        yield ids_now, texts_now


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """Give memory back to the system after each task: workers stay alive for the next one."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def row_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Blocks of (id, text) from Arrow batches whose first two columns are id and text bytes."""
    for batch in batches:
        yield from text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist())
