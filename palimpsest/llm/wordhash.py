"""Vectorised word and window hashes over Arrow string columns.

Words are runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  A word's hash is a
polynomial in its bytes and a window's hash (Rabin-Karp) a polynomial in its words'
hashes, both modulo 2**64 and finished by a mixing step, so that equal words give equal
hashes in every task and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finishing step on uint64 (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words of several texts in order: ``hashes``; text i owns hashes[bounds[i]:bounds[i+1]]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) pieces of a string column of about ``max_bytes``; one text is never cut."""
    if pa.types.is_large_string(texts.type) is False:
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def words(texts: pa.Array, fold_case: bool = False) -> Words:
    """Hashes of all words of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cut = offsets[1:-1] - 1
    after[cut[cut >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.empty(0, np.uint64), bounds, starts, ends, data)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BYTE_BASE, dtype=np.uint64))
    values = (_FOLDED if fold_case else _BYTES)[data[at]]
    values *= powers[place]
    return Words(mix64(np.add.reduceat(values, firsts)), bounds, starts, ends, data)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all ``width``-word windows of one word sequence (len - width + 1 of them).

    h(i) = sum of hashes[i+j] * WORD_BASE**(width-1-j); built by doubling, unmixed.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out: np.ndarray | None = None
    done, power, span = 0, hashes, 1
    while True:
        if width & span:
            part = power[done : done + n] if out is not None else power[:n]
            out = part.copy() if out is None else out * np.uint64(pow(WORD_BASE, span, 1 << 64)) + part
            done += span
        if (span << 1) > width:
            return out
        power = power[:-span] * np.uint64(pow(WORD_BASE, span, 1 << 64)) + power[span:]
        span <<= 1


def window_starts(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """Mask over the total-width+1 window starts: true where the window lies in one text."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    owner_end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + width <= owner_end[:n]
