"""Words of a batch of texts as numpy arrays, straight from Arrow buffers.

A batch is cut into slices of a few megabytes, at document borders only, so
memory stays bounded and every text is seen whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

# Odd multipliers for polynomial hashes modulo 2**64.
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)

# The two ways of telling words apart, as tables over byte values.  Bytes of
# 128 and more belong to characters beyond ASCII, which are word characters in both.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in `data`, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    rows: range

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """Number of the text, within this slice, that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def joined(self, start: int, stop: int) -> bytes:
        """Words start to stop - 1 with one space between them."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[start:stop], self.ends[start:stop]))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[range]:
    """Ranges of texts with at most `limit` bytes each, or one longer text alone."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(offsets) - 1)
        yield range(start, stop)
        start = stop


def words(texts: pa.Array, is_word: np.ndarray, lower: bool = False) -> Iterator[Words]:
    """The words of the texts, slice by slice."""
    raw, offsets = flat(texts)
    for rows in slices(offsets):
        lo, hi = offsets[rows.start], offsets[rows.stop]
        data = LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        inside = is_word[data]
        borders = offsets[rows.start : rows.stop + 1] - lo
        yield Words(data, *_bounds(inside, borders), rows)


def _bounds(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of `inside`, cut at the borders between texts."""
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = borders[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, borders)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; a bijection."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(found: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(found.starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = found.ends - found.starts
    # Bytes of words only, one after the other.
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = found.data[np.repeat(found.starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    values *= powers(_BYTE_BASE, int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words, also across borders: callers leave those out."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for place, factor in enumerate(powers(_WORD_BASE, size)):
        total += hashes[place : place + count] * factor
    return mixed(total)


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Words at which a whole window of one text begins, in order."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(int(counts.sum())) + shift


def covered(starts: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of `count` words lie in a window of `size` words that begins at one of `starts`."""
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, count), -1)
    return np.cumsum(change[:-1]) > 0
