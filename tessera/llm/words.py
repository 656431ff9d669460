"""Vectorised word hashing over Arrow string columns.

Texts are read as the UTF-8 bytes of an Arrow column; separators are single ASCII bytes, which never
occur inside a multi-byte character, so words are found on bytes. A word hash is a polynomial sum of
random byte values modulo 2^64, mixed; its arrays are bounded by ``BLOCK`` bytes however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 21

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1

SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


@lru_cache(maxsize=4)
def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def separator_table(separators: bytes) -> np.ndarray:
    """True at the bytes that end a word."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


def value_table(zero: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash value of each byte: zero where told, A-Z as a-z if ``lower``."""
    values = _byte_values().copy()
    values[zero] = 0
    if lower:
        values[65:91] = values[97:123]
    return values


SPACES = separator_table(SPACE_BYTES)
WORDS_AS_THEY_ARE = value_table(SPACES)
WORDS_LOWER = value_table(SPACES, lower=True)
LINES = value_table(separator_table(b"\n"))
IS_SYMBOL = separator_table(b"#*$%&|<>")
#: Not a continuation byte of UTF-8: one such byte per code point.
STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a multiply-xorshift hash)."""
    out = values + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & MASK)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def segment_hashes(data: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes from one start to the next, independent of where it lies.

    Bytes of value zero count for nothing, so a word's hash ignores the separators behind it.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    powers, inverses = _powers(BASE), _powers(BASE_INVERSE)
    scales = []
    for begin in range(0, len(data), BLOCK):
        block = values[data[begin:begin + BLOCK]]
        block *= powers[: len(block)]
        scale = np.uint64(pow(BASE, begin, 1 << 64))
        scales.append(pow(BASE_INVERSE, begin, 1 << 64))
        low, high = np.searchsorted(starts, (begin, begin + len(block)))
        first = int(starts[low]) - begin if low < high else len(block)
        if low and first:
            out[low - 1:low] += block[:first].sum(dtype=np.uint64) * np.full(1, scale)
        if low < high:
            out[low:high] += np.add.reduceat(block, starts[low:high] - begin) * scale
    out *= inverses[starts % BLOCK]
    out *= np.array(scales, np.uint64)[starts // BLOCK]
    return mix(out)


def segment_sums(data: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of byte values in each run of bytes from one start to the next."""
    if not len(starts):
        return np.zeros(0, np.int64)
    total = np.zeros(len(starts) + 1, np.int64)
    edges = np.append(starts, len(data))
    for begin in range(0, len(data), BLOCK):
        block = values[data[begin:begin + BLOCK]]
        low, high = np.searchsorted(starts, (begin, begin + len(block)))
        first = int(edges[low]) - begin if low < high else len(block)
        if low and first:
            total[low - 1] += block[:first].sum(dtype=np.int64)
        if low < high:
            total[low:high] += np.add.reduceat(block.astype(np.int64), starts[low:high] - begin)
    return total[:-1]


@dataclass
class Chunk:
    """Consecutive texts: their bytes, and where each begins (one more offset at the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def word_starts(self, separators: np.ndarray) -> np.ndarray:
        inside = ~separators[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        begins = self.offsets[:-1]
        before[begins[begins < len(inside)]] = False
        return np.flatnonzero(inside & ~before)

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """Offsets into sorted positions: those of text i are [out[i], out[i + 1])."""
        return np.searchsorted(positions, self.offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
        if (lengths != np.diff(ends)).any():
            return text_buffers(column.fill_null(""))
    return raw[ends[0]:ends[-1]], ends - ends[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole texts of about ``limit`` bytes, a longer text alone."""
    data, offsets = text_buffers(column)
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), count)
        begin, end = offsets[first], offsets[last]
        yield Chunk(first, data[begin:end], offsets[first:last + 1] - begin)
        first = last


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; the last ``size - 1`` words begin none."""
    count = max(0, len(words) - size + 1)
    out = np.zeros(count, np.uint64)
    weight = 1
    for k in range(size):
        weight = weight * 0xA0761D6478BD642F & MASK
        out += words[k:k + count] * np.uint64(weight)
    return mix(out, size)


def within(word_offsets: np.ndarray, size: int, count: int) -> np.ndarray:
    """True at the windows (of all word positions that begin one) that end in the text they begin in."""
    inside = np.ones(max(0, count - size + 1), bool)
    for back in range(1, size):
        at = word_offsets[1:-1] - back
        at = at[(at >= 0) & (at < len(inside))]
        inside[at] = False
    return inside
