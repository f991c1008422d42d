"""Words of Arrow text columns as numpy arrays: boundaries, hashes, runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that are looked at together; bounds the arrays of one step.
BYTES_AT_ONCE = 2 << 20

# White space between words, by the contracts of the operators.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
# Odd multipliers of a 64-bit mixing function.
MULTIPLY_1 = np.uint64(0x9E3779B97F4A7C15)
MULTIPLY_2 = np.uint64(0xBF58476D1CE4E5B9)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WHITE_SPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def is_letter_byte() -> np.ndarray:
    """ASCII letters and every byte of a longer UTF-8 sequence."""
    table = np.zeros(256, dtype=bool)
    table[65:91] = table[97:123] = True
    table[128:] = True
    return table


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and the rows' offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + rows + 1
    ]
    if not rows or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(rows + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return _LOWER[data]


def word_runs(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and row numbers of the maximal runs of word bytes.

    A run ends with its row, whatever the next row begins with.
    """
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = is_word[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    ends = inside[:-1] & ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[:-1][first]
    last = first[1:] - 1
    ends[last] = inside[:-1][last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    values = (values ^ (values >> np.uint64(31))) * MULTIPLY_2
    return values ^ (values >> np.uint64(29))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run, eight bytes at a time over all runs together."""
    lengths = ends - starts
    hashes = mixed(lengths.astype(np.uint64) * MULTIPLY_1 + np.uint64(seed))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live = np.arange(len(starts))
    at, left = starts, lengths
    while len(live):
        piece = eights[at] & _MASKS[np.minimum(left, 8)]
        hashes[live] = mixed((hashes[live] ^ piece) * MULTIPLY_1)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return hashes


def in_parts(batch: pa.RecordBatch, column: str | int, size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def crc_class(column: str, buckets: int) -> Column:
    """crc32 of an id as text, modulo ``buckets``; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % buckets
