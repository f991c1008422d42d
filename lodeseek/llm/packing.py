"""Token sequences of fixed capacity by harmonic packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.text import (
    MULTIPLY_1,
    WHITE_SPACE,
    bytes_of,
    hash_runs,
    in_parts,
    lowered,
    mixed,
    ragged_ranges,
    word_runs,
)
from lodeseek.session import load_table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# A piece that would leave more than this share of its bin empty is cut.
WASTE = 1 / 64
# Units given to the tokenizer as one string, and units that a task remembers.
UNITS_AT_ONCE, MOST_KNOWN = 4096, 1_000_000

_SPACE, _LETTERS, _DIGITS, _SIGNS, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[33:127] = _SIGNS
_KIND[39] = _ODD
_KIND[48:58] = _DIGITS
_KIND[65:91] = _KIND[97:123] = _LETTERS
_KIND[list(WHITE_SPACE)] = _SPACE
_C3_LETTER = np.zeros(256, dtype=bool)
_C3_LETTER[0x80:0xC0] = True
# The second bytes of the two signs in that range, U+00D7 and U+00F7.
_C3_LETTER[[0x97, 0xB7]] = False

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class UnitTokenizer:
    """Ids of whole texts; a task tokenizes every distinct unit of its texts once.

    Fits tokenizers that lower their input and part it at white space and between letters,
    single digits and signs, with an end-of-word mark on the last id of every part. A unit
    is such a part. Words with anything but ASCII and the letters of U+00C0 to U+00FF, with
    an apostrophe or the beginning of a special token are one unit each, given as they are
    and between special tokens, so that the tokenizer itself parts them.
    """

    def __init__(self, path: str, separator: str = "<|startoftext|>", end_mark: str = "</w>"):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = separator
        self.separator_id = self.tokenizer.token_to_id(separator)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end_mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.places = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.table = np.zeros(0, dtype=np.int32)

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def parts(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units that are one part each, and their lengths."""
        ids = [
            self._encoded(" ".join(units[at : at + UNITS_AT_ONCE]))
            for at in range(0, len(units), UNITS_AT_ONCE)
        ]
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(units):
            raise ValueError("the tokenizer parts its input in another way")
        return flat, np.diff(stops, prepend=0)

    def odd_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the tokenizer has to part, and their lengths."""
        flat, lengths = [], []
        for word in [w for w in words if "<|" in w]:
            flat.append(self._encoded(word))
            lengths.append([len(flat[-1])])
        plain = [w for w in words if "<|" not in w]
        for at in range(0, len(plain), UNITS_AT_ONCE):
            found = self._encoded(self.separator.join(plain[at : at + UNITS_AT_ONCE]))
            cuts = np.flatnonzero(found == self.separator_id)
            lengths.append(np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1)
            flat.append(np.delete(found, cuts))
        if not flat:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return np.concatenate(flat), np.concatenate(lengths).astype(np.int64)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's rows, one after another, and the rows' offsets."""
        data, offsets = bytes_of(column)
        data, starts, ends, rows, odd = _units(data, offsets)
        # An odd word and a part may read alike; they are told apart by their seed.
        hashes = hash_runs(data, starts, ends)
        hashes[odd] = mixed(hashes[odd] + MULTIPLY_1)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(data, distinct[new], starts[first[new]], ends[first[new]], odd[first[new]])
            at = self._find(distinct)
        per_unit = self.lengths[at][inverse]
        flat = self.table[ragged_ranges(self.places[at][inverse], per_unit)]
        sizes = np.bincount(rows, weights=per_unit, minlength=len(column)).astype(np.int64)
        if len(self.known) > MOST_KNOWN:
            self._forget()
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def _learn(
        self,
        data: np.ndarray,
        hashes: np.ndarray,
        starts: np.ndarray,
        ends: np.ndarray,
        odd: np.ndarray,
    ) -> None:
        raw = data.tobytes()

        def strings(which: np.ndarray) -> list[str]:
            return [raw[b:e].decode() for b, e in zip(starts[which].tolist(), ends[which].tolist())]

        plain, others = np.flatnonzero(~odd), np.flatnonzero(odd)
        words = strings(others)
        # `odd_words` answers words with a special token's beginning first.
        marked = np.array(["<|" in w for w in words], dtype=bool)
        others = np.concatenate([others[marked], others[~marked]])
        flat_1, lengths_1 = self.parts(strings(plain))
        flat_2, lengths_2 = self.odd_words(words)
        lengths = np.concatenate([lengths_1, lengths_2])
        places = len(self.table) + np.cumsum(lengths) - lengths
        self.table = np.concatenate([self.table, flat_1, flat_2])
        known = np.concatenate([self.known, hashes[plain], hashes[others]])
        order = np.argsort(known)
        self.known = known[order]
        self.places = np.concatenate([self.places, places])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]


def _units(
    data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lower case but in odd words), and starts, ends, rows and oddness of all units."""
    kind = _KIND[data]
    if len(data) > 1:
        # Two bytes of a letter from U+00C0 to U+00FF.
        letter = (data[:-1] == 0xC3) & _C3_LETTER[data[1:]]
        kind[:-1][letter] = _LETTERS
        kind[1:][letter] = _LETTERS
        kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = _ODD
    starts, ends, _ = word_runs(data, offsets)
    odd_before = np.concatenate([[0], np.cumsum(kind == _ODD)])
    odd_words = odd_before[ends] > odd_before[starts]
    kind[ragged_ranges(starts[odd_words], (ends - starts)[odd_words])] = _ODD
    small = np.where(kind == _ODD, data, lowered(data))
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGITS)
    edge[offsets[:-1]] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    used = kind[starts] != _SPACE
    starts, ends = starts[used], ends[used]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return small, starts, ends, rows, kind[starts] == _ODD


def piece_lengths(length: int, capacity: int = CAPACITY) -> list[int]:
    """How a text of ``length`` ids is cut: whole bins, then reciprocal parts of one.

    A rest that nearly fills its share of a bin (class k takes k equal shares) stays
    whole. Another is cut at the largest share that it can fill.
    """
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= WASTE * capacity:
            pieces.append(rest)
            break
        share = capacity // (k + 1)
        pieces.append(share)
        rest -= share
    return pieces


def powers_of_two(length: int, capacity: int) -> list[int]:
    """Whole bins and then one sequence for every binary digit of the rest."""
    rest = length % capacity
    digits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [capacity] * (length // capacity) + digits


class HarmonicBins:
    """One worker's open bins: per class k those pieces that wait for k of their kind."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next_sequence = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """Takes (row, start, ids, doc_tokens); returns the pieces of a bin that it fills."""
        k = self.capacity // len(piece[2])
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) < k:
            return []
        self.open[k] = []
        return self._sequence(waiting)

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        placed, offset = [], 0
        for row, start, ids, tokens in pieces:
            placed.append((row, start, ids, tokens, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1
        return placed

    def close(self) -> list[tuple]:
        """What waits, joined and cut anew: full bins, then powers of two without padding."""
        waiting = [p for k in sorted(self.open) for p in self.open[k]]
        placed: list[tuple] = []
        for size in powers_of_two(sum(len(p[2]) for p in waiting), self.capacity):
            taken, room = [], size
            while room:
                row, start, ids, tokens = waiting[0]
                taken.append((row, start, ids[:room], tokens))
                if len(ids) > room:
                    waiting[0] = (row, start + room, ids[room:], tokens)
                else:
                    waiting.pop(0)
                room -= min(room, len(ids))
            placed += self._sequence(taken)
        self.open = {}
        return placed


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all texts' ids, each at its place in a sequence of ``capacity`` ids.

    Texts (NULL: empty) become ids followed by ``end_id``; an empty text is that one id.
    Long texts fill whole bins. What is left falls into classes: lengths over
    capacity / (k + 1) up to capacity / k are class k, and k of them make a bin. A piece
    much shorter than its class allows is cut at the next share, so that no bin leaves
    more than one sixty-fourth empty. Every task fills its own bins and at its end joins
    what waits in unfilled ones, fewer than k pieces per class, into full sequences and
    some whose lengths are powers of two. Nothing is shuffled; memory is one batch and the
    open bins. ``sequence_id`` holds task and number and repeats when a task runs again.

    Columns: the id, ``start`` (ids of its text before the piece), ``length``, ``ids`` (NULL
    unless ``with_ids``), ``ids_crc32`` (of the ids as little-endian 32-bit integers),
    ``doc_tokens``, ``sequence_id``, ``offset``. Other columns of ``df`` are not read.
    Repeated rows and NULL ids are packed like any other row.
    """
    schema = T.StructType([*df.select(id_col).schema.fields, *PIECES.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = UnitTokenizer(tokenizer_path)
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        arrow = _arrow_schema(schema)
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                ids, offsets = tokenizer.texts(batch.column("__text"))
                row_ids = batch.column("__id").to_pylist()
                placed: list[tuple] = []
                for row, a, b in zip(row_ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = np.append(ids[a:b], np.int32(end_id))
                    start = 0
                    for length in piece_lengths(len(own), capacity):
                        placed += bins.add((row, start, own[start : start + length], len(own)))
                        start += length
                yield from _rows(placed, arrow, with_ids)
        yield from _rows(bins.close(), arrow, with_ids)

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        work, schema
    )


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(placed: list[tuple], schema: pa.Schema, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces as Arrow batches of a bounded number of ids."""
    for at in range(0, len(placed), 2000):
        part = placed[at : at + 2000]
        row, start, ids, tokens, sequence, offset = zip(*part)
        lengths = np.fromiter((len(x) for x in ids), dtype=np.int64, count=len(ids))
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            lists = lists.cast(schema.field(3).type)
        else:
            lists = pa.nulls(len(part), schema.field(3).type)
        columns = [
            pa.array(row, schema.field(0).type),
            pa.array(start, pa.int64()),
            pa.array(lengths),
            lists,
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array(sequence, pa.int64()),
            pa.array(offset, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    """The digest of every piece of ``docs`` that the query and the pipeline return."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path(TOKENIZER), with_ids=False)
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packed_documents(load_table(spark, sf_dir, "documents"))
