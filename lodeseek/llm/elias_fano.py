"""Elias-Fano sequences and an n-gram trie over them, memory-mapped."""

from __future__ import annotations

import tempfile

import numpy as np

_ONE = np.uint64(1)
_SIXTY_THREE = np.uint64(63)
# Probabilities are kept as whole steps of 1/2048 of a power of ten, from 10^-16 up.
STEPS, LOWEST = 2048.0, 16.0
# Bits of a context below its word, and of the context before it below the pair.
CONTEXT_BITS, SECOND_BITS = 40, 32


class MappedFile:
    """Arrays written one after another to a nameless file, then read through its map."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def put(self, values: np.ndarray) -> np.ndarray:
        """Writes ``values`` and returns them as a read-only map of the file."""
        if not len(values):
            return values
        self.file.seek(0, 2)
        at = -(-self.file.tell() // 8) * 8
        self.file.seek(at)
        self.file.write(memoryview(np.ascontiguousarray(values)).cast("B"))
        self.file.flush()
        return np.memmap(self.file, dtype=values.dtype, mode="r", offset=at, shape=values.shape)

    def close(self) -> None:
        self.file.close()


class EliasFano:
    """A non-decreasing sequence of 64-bit values below ``2 ** bits``.

    The low bits lie packed; the high bits are unary in a bit vector, in which the zero
    that ends a bucket of equal high bits is found by counts of zeros per word.
    """

    def __init__(self, values: np.ndarray, bits: int, store: MappedFile):
        self.size = len(values)
        room = bits - max(1, self.size).bit_length()
        self.low_bits = max(0, min(room, 63))
        shift = np.uint64(self.low_bits)
        high = (values >> shift).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if self.size else 0
        places = high + np.arange(self.size)
        words = np.zeros((self.size + self.buckets) // 64 + 1, dtype=np.uint64)
        np.bitwise_or.at(words, places >> 6, _ONE << (places & 63).astype(np.uint64))
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self.high = store.put(words)
        self.zeros = store.put(np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype(np.int64))
        self.low = store.put(self._packed(values & ((_ONE << shift) - _ONE)))

    def _packed(self, low: np.ndarray) -> np.ndarray:
        words = np.zeros(self.size * self.low_bits // 64 + 2, dtype=np.uint64)
        if not self.low_bits:
            return words
        at = np.arange(self.size, dtype=np.int64) * self.low_bits
        off = (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, at >> 6, low << off)
        np.bitwise_or.at(words, (at >> 6) + 1, (low >> _ONE) >> (_SIXTY_THREE - off))
        return words

    def _low_at(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.uint64)
        at = index * self.low_bits
        off = (at & 63).astype(np.uint64)
        value = self.low[at >> 6] >> off
        value |= (self.low[(at >> 6) + 1] << _ONE) << (_SIXTY_THREE - off)
        return value & ((_ONE << np.uint64(self.low_bits)) - _ONE)

    def _zero(self, number: np.ndarray) -> np.ndarray:
        """Places of the zeros with these numbers, from 0."""
        word = np.searchsorted(self.zeros, number, "right") - 1
        rest = number - self.zeros[word]
        bits = ~self.high[word]
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << width) - 1)
            inside = np.bitwise_count(bits & mask).astype(np.int64)
            over = rest >= inside
            rest -= np.where(over, inside, 0)
            bits = np.where(over, bits >> np.uint64(width), bits)
            place += np.where(over, width, 0)
        return place

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is not below each key (the size if none is), and
        whether it equals the key."""
        bucket = (keys >> np.uint64(self.low_bits)).astype(np.int64)
        beyond = (bucket >= self.buckets) | (bucket < 0)
        bucket = np.where(beyond, 0, bucket)
        if not self.size:
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        stop = self._zero(bucket) - bucket
        previous = np.maximum(bucket - 1, 0)
        first = np.where(bucket > 0, self._zero(previous) - previous, 0)
        want = keys & ((_ONE << np.uint64(self.low_bits)) - _ONE)
        low, high = first.copy(), stop.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            below = self._low_at(middle) < want[live]
            low[live] = np.where(below, middle + 1, low[live])
            high[live] = np.where(below, high[live], middle)
            live = live[low[live] < high[live]]
        equal = ~beyond & (low < stop)
        hit = np.flatnonzero(equal)
        equal[hit] = self._low_at(low[hit]) == want[hit]
        return np.where(beyond, self.size, low), equal

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values by index: the place of the index's one bit, less the index, and its low bits."""
        ones = np.arange(len(self.high), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, index, "right") - 1
        rest = index - ones[word]
        bits = self.high[word].copy()
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << width) - 1)
            inside = np.bitwise_count(bits & mask).astype(np.int64)
            over = rest >= inside
            rest -= np.where(over, inside, 0)
            bits = np.where(over, bits >> np.uint64(width), bits)
            place += np.where(over, width, 0)
        high = (place - index).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low_at(index)


def quantised(log10: np.ndarray) -> np.ndarray:
    """Logarithms as steps, rounded down: a stored probability is never too large."""
    return np.clip(np.floor((log10 + LOWEST) * STEPS), 0, 65535).astype(np.uint16)


def restored(steps: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) / STEPS - LOWEST


def raised(log10: np.ndarray) -> np.ndarray:
    """Logarithms as steps, rounded up: what a probability is divided by is never too small."""
    return np.clip(np.ceil((log10 + LOWEST) * STEPS), 0, 65535).astype(np.uint16)


class Level:
    """What stands below the entries of the level above, relative to them.

    The parent's place in the upper bits keeps the whole level non-decreasing, so one
    sequence serves all parents; non-decreasing pointers say where each parent's part is.
    An entry has a weight and, but for the last level, a divisor of what follows it.
    """

    def __init__(
        self,
        store: MappedFile,
        above: int,
        parents: np.ndarray,
        contexts: np.ndarray,
        bits: int,
        weights: np.ndarray,
        follows: np.ndarray | None = None,
    ):
        """``above`` parents; entries sorted by parent's place and context."""
        self.bits = np.uint64(bits)
        ends = np.searchsorted(parents, np.arange(above + 1)).astype(np.uint64)
        self.pointers = EliasFano(ends, max(1, len(contexts).bit_length()), store)
        relative = (parents.astype(np.uint64) << self.bits) | contexts
        self.contexts = EliasFano(relative, min(bits + max(1, above.bit_length()), 64), store)
        self.weights = store.put(quantised(weights))
        self.follows = None if follows is None else store.put(raised(follows))

    def find(self, parents: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts below their parents, and whether they are there."""
        place, hit = self.contexts.successor((parents.astype(np.uint64) << self.bits) | contexts)
        at = np.flatnonzero(hit)
        # The successor must lie in its parent's own part.
        begin = self.pointers.at(parents[at]).astype(np.int64)
        end = self.pointers.at(parents[at] + 1).astype(np.int64)
        hit[at] = (place[at] >= begin) & (place[at] < end)
        return place, hit


class NgramTrie:
    """Words, the contexts below them, and the contexts before those, with quantised weights.

    Level one holds sorted word hashes, exact counts, the weight of the word in a context it
    was not seen in, and the divisor of what follows it; level two the same of pairs; level
    three the weights of triples.
    """

    def __init__(
        self,
        words: np.ndarray,
        counts: np.ndarray,
        weights: np.ndarray,
        follows: np.ndarray,
        pairs: tuple[np.ndarray, ...],
        triples: tuple[np.ndarray, ...],
    ):
        """``pairs`` are (word's rank, context, weight, follows), ``triples`` (pair's place,
        second context, weight), each sorted by the first two."""
        self.store = MappedFile()
        self.words = EliasFano(words, 64, self.store)
        self.counts = self.store.put(counts.astype(np.int64))
        self.weights = self.store.put(quantised(weights))
        self.follows = self.store.put(raised(follows))
        self.pairs = Level(self.store, len(words), *pairs[:2], CONTEXT_BITS, *pairs[2:])
        self.triples = Level(self.store, len(pairs[0]), *triples[:2], SECOND_BITS, triples[2])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of words, and whether they are there."""
        return self.words.successor(words)

    def close(self) -> None:
        self.store.close()
