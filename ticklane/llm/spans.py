"""Vectorised text work inside tasks: words, lines and their hashes straight from Arrow's UTF-8 buffers.

Every word rule used here is a set of ASCII bytes, and no UTF-8 byte of a longer character is below 0x80, so words can
be cut on bytes. Nothing here knows about Spark: the functions take arrays, and the operators call them from
``mapInArrow`` on batches that Spark has dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; one longer text is handled alone.
PIECE = 2_000_000
#: Texts in a piece at most, so that 16 bits number them.
PIECE_TEXTS = 60_000


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask of the byte values in the inclusive ranges."""
    mask = np.zeros(256, bool)
    for low, high in ranges:
        mask[low : high + 1] = True
    return mask


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM_BYTES = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NEWLINE = byte_set((0x0A, 0x0A))
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 0x20


class Texts:
    """Some texts as one byte array: text i is data[bounds[i]:bounds[i + 1]]; null is empty."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def runs(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of bytes outside ``separators``."""
        inside = ~separators[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = self.bounds[1:-1]
        at = edge[(edge > 0) & (edge < len(inside))]
        begins[at] = inside[at]
        ends[at - 1] = inside[at - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(self.bounds, start, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each line (between newlines), empty ones too; a text has one at least."""
        cuts = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.bounds, cuts, side="right") - 1
        n = len(self)
        start = np.concatenate([self.bounds[:-1], cuts + 1])
        end = np.concatenate([cuts, self.bounds[1:]])
        text = np.concatenate([np.arange(n), owner])
        order = np.lexsort((start, text))
        upto = np.lexsort((end, np.concatenate([owner, np.arange(n)])))
        return start[order], end[upto], text[order]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Texts]:
    """The texts of an Arrow string column, in order, in pieces of about ``limit`` bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        last = min(last, len(column), first + PIECE_TEXTS)
        yield Texts(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first)
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(max(n, 2 * len(_POWERS), 1024), _BASE, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(step)
    return _POWERS[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (ordered, not overlapping): a polynomial by position, then mixed; empty: of no byte."""
    n = end - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        s, length = start[full], n[full]
        place = np.arange(int(length.sum()), dtype=np.int32 if data.size < 1 << 31 else np.int64)
        place -= np.repeat((np.cumsum(length) - length).astype(place.dtype), length)
        taken = data[np.repeat(s, length) + place] if (data.size != place.size) else data
        with np.errstate(over="ignore"):
            terms = (taken.astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[place]
            out[full] = np.add.reduceat(terms, np.cumsum(length) - length)
            out += n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(out)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values, whatever texts they belong to; len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(_BASE) + hashes[i : i + n]
    return mixed(out)


def within_text(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Keys that are equal for equal hashes of one text: the text number in as many high bits as n needs, then hash bits."""
    bits = np.uint64(max(1, int(n).bit_length()))
    return (text.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)


def sums(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Totals by text."""
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
