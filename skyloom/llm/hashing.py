"""Words, shingles and their hashes over Arrow string batches, without a loop per word.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes; A-Z may be lower-cased first.  A word's
hash is a polynomial in its bytes (prefix sums make every word's hash one subtraction),
finished by a 64-bit mixer; a shingle's hash combines its words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z = z ^ (z >> np.uint64(27))
    z = z * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


class Powers:
    """Powers of the base and of its inverse, grown on demand; one per task."""

    def __init__(self):
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in slices of at most ``limit`` bytes of text (one row at least).

    Slices bound the memory of the arrays derived from the bytes; NULL counts as empty.
    """
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of one slice: byte ranges, their document and the words before each document; ``is_word`` marks their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD):
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = is_word[data]
        begins = inside[1:] & ~inside[:-1]
        finishes = inside[:-1] & ~inside[1:]
        # A document's border ends a word even where no blank stands between two texts.
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        touching = edge[inside[edge] & inside[edge + 1]]
        begins[touching] = True
        finishes[touching] = True
        self.data, self.starts, self.ends = data, np.flatnonzero(begins), np.flatnonzero(finishes)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        self.docs = len(offsets) - 1
        self.counts = np.diff(self.first)

    def hashes(self, powers: Powers, lower: bool = True) -> np.ndarray:
        up, down = powers.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((_LOWER_VALUES if lower else _BYTE_VALUES)[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def shingles(self, powers: Powers, width: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, first word) of every window of ``width`` words.

        A document with fewer words gives one shingle of all its words; one without, none.
        """
        words = self.hashes(powers, lower)
        total = len(words)
        combined = np.zeros(total, dtype=np.uint64)
        left = self.first[1:][self.doc] - np.arange(total)
        for k in range(width):
            at = np.zeros(total, dtype=np.uint64)
            at[:max(total - k, 0)] = words[k:]
            at[left <= k] = np.uint64(0)
            combined = mix(combined * np.uint64(0xFF51AFD7ED558CCD) + at + np.uint64(k + 1))
        whole = (left >= width) | ((np.arange(total) == self.first[:-1][self.doc]) & (left < width))
        keep = np.flatnonzero(whole)
        return combined[keep], self.doc[keep], keep
