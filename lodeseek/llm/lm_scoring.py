"""Language-model scores of whole texts from a sharded n-gram trie."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.elias_fano import CONTEXT_BITS, SECOND_BITS, NgramTrie, restored
from lodeseek.llm.text import (
    MULTIPLY_1,
    bytes_of,
    crc_class,
    hash_runs,
    in_parts,
    lowered,
    mixed,
    ragged_ranges,
    word_runs,
)
from lodeseek.session import load_table, materialize

# What a pair's count and the words' own probabilities weigh beside the count of a triple.
PAIR_SHARE, PRIOR = 0.003, 3.0
PART_BYTES, LEAST_PARTS, MOST_PARTS = 16 << 20, 48, 1 << 20
# A word, pair or triple with over this share of a part's tokens is spread over parts.
SPREAD_SHARE = 1 / 8
BLOCK_TOKENS, BLOCK_ROWS = 1 << 19, 65_535
# Tokens of a part that are counted and answered together, about; a word is never divided.
SLICE_TOKENS = 1 << 18

START, END = np.uint64(2), np.uint64(1)
_CONTEXT_MASK = np.uint64((1 << CONTEXT_BITS) - 1)
_SECOND_MASK = np.uint64((1 << SECOND_BITS) - 1)


@dataclass
class Block:
    """Consecutive documents as token arrays: word, the two before it, document number."""

    words: np.ndarray
    contexts: np.ndarray
    seconds: np.ndarray
    rows: np.ndarray
    train: np.ndarray
    ids: pa.Array


def _tokens(batch: pa.RecordBatch) -> Block:
    data, offsets = bytes_of(batch.column("__text"))
    data = lowered(data)
    starts, ends, rows = word_runs(data, offsets)
    per_row = np.bincount(rows, minlength=batch.num_rows)
    last = np.cumsum(per_row) + np.arange(batch.num_rows)
    words = np.empty(len(starts) + batch.num_rows, dtype=np.uint64)
    words[np.arange(len(starts)) + rows] = hash_runs(data, starts, ends)
    words[last] = END
    first = last[:-1] + 1
    contexts = _before(words, first)
    return Block(
        words,
        contexts,
        _before(contexts, first),
        np.repeat(np.arange(batch.num_rows, dtype=np.uint16), per_row + 1),
        batch.column("__train").to_numpy(zero_copy_only=False).astype(bool),
        batch.column("__id"),
    )


def _before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value before each; START before those of the places ``first`` and the very first."""
    result = np.empty_like(values)
    result[1:] = values[:-1]
    result[first] = START
    result[:1] = START
    return result


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about BLOCK_TOKENS tokens; a longer text is a block of its own."""
    held: list[Block] = []
    for whole in batches:
        for batch in in_parts(whole, "__text"):
            for at in range(0, batch.num_rows, 8192):
                held.append(_tokens(batch.slice(at, 8192)))
                if (
                    sum(len(b.words) for b in held) >= BLOCK_TOKENS
                    or sum(len(b.ids) for b in held) > BLOCK_ROWS - 8192
                ):
                    yield _joined(held)
                    held = []
    if held:
        yield _joined(held)


def _joined(parts: list[Block]) -> Block:
    before = np.cumsum([0, *[len(p.ids) for p in parts]])
    return Block(
        np.concatenate([p.words for p in parts]),
        np.concatenate([p.contexts for p in parts]),
        np.concatenate([p.seconds for p in parts]),
        np.concatenate([p.rows + np.uint16(n) for p, n in zip(parts, before)]),
        np.concatenate([p.train for p in parts]),
        pa.concat_arrays([p.ids for p in parts]),
    )


def _counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(values, return_inverse=True)
    return distinct, np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)


def vocabulary(rows: DataFrame, parts: int) -> DataFrame:
    """Sorted words and counts of the training texts, one row per part of the hash range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, counts = np.unique(block.words[block.train[block.rows]], return_counts=True)
            part = (words % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    _blobs(words[order], cuts, full),
                    _blobs(counts[order].astype(np.uint32), cuts, full),
                ],
                names=["part", "words", "counts"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        part, held = None, []

        def folded():
            return _counted(
                np.concatenate([words, *[h[0] for h in held]]),
                np.concatenate([counts, *[h[1] for h in held]]),
            )

        for batch in batches:
            for number, w, c in zip(*[batch.column(i) for i in range(3)]):
                part = number.as_py()
                held.append(
                    (np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32))
                )
            if sum(len(h[0]) for h in held) > max(1 << 20, len(words)):
                words, counts = folded()
                held = []
        words, counts = folded()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([words.tobytes()], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()),
                pa.array([len(words)], pa.int64()),
                pa.array([int(counts.sum())], pa.int64()),
            ],
            names=["part", "words", "counts", "distinct", "total"],
        )

    partial = rows.mapInArrow(count, "part int, words binary, counts binary")
    return partial.groupBy("part").applyInArrow(
        merge, "part int, words binary, counts binary, distinct long, total long"
    )


def _blobs(values: np.ndarray, cuts: np.ndarray, chosen: np.ndarray) -> pa.Array:
    """Chosen stretches of an array as binary values."""
    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    size = values.itemsize
    return pa.array(
        [bytes(raw[cuts[i] * size : cuts[i + 1] * size]) for i in chosen.tolist()], pa.binary()
    )


def frequent_words(vocab: DataFrame, over: int) -> dict[int, int]:
    """Words (as signed hashes) with more than ``over`` occurrences."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(batch.column(0), batch.column(1)):
                counts = np.frombuffer(c.as_buffer(), np.int64)
                found = counts > over
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(w.as_buffer(), np.int64)[found]),
                        pa.array(counts[found]),
                    ],
                    names=["word", "n"],
                )

    rows = vocab.select("words", "counts").mapInArrow(pick, "word long, n long").collect()
    return {r["word"]: r["n"] for r in rows}


def frequent_pairs(rows: DataFrame, words: dict[int, int], over: int) -> dict[tuple[int, int], int]:
    """(word, context) pairs with more than ``over`` occurrences in training texts.

    Both halves of such a pair are frequent words or the start, so only those are counted.
    """
    inside = np.sort(np.array([*words, START, END], dtype=np.int64).view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            use = block.train[block.rows] & _member(block.words, inside)
            use[use] = _member(block.contexts[use], inside)
            pairs = [block.words[use], block.contexts[use]]
            one, counts = _first_of(mixed(pairs[0] ^ mixed(pairs[1])))
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(column[one].view(np.int64)) for column in pairs],
                    pa.array(counts),
                ],
                names=["word", "context", "n"],
            )

    counted = (
        rows.mapInArrow(count, "word long, context long, n long")
        .groupBy("word", "context")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > over)
    )
    return {(r["word"], r["context"]): r["n"] for r in counted.collect()}


def frequent_triples(
    rows: DataFrame, pairs: dict[tuple[int, int], int], over: int
) -> dict[tuple[int, int, int], int]:
    """(word, context, second context) with more than ``over`` occurrences in training texts.

    Such a triple ends in a frequent pair and begins with one, or with the start.
    """
    inside = np.sort(_pair_keys(*_columns(pairs, 2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            use = np.flatnonzero(block.train[block.rows])
            use = use[_member(_pair_keys(block.words[use], block.contexts[use]), inside)]
            begins = block.contexts[use] == START
            begins |= _member(_pair_keys(block.contexts[use], block.seconds[use]), inside)
            use = use[begins]
            triples = [block.words[use], block.contexts[use], block.seconds[use]]
            one, counts = _first_of(mixed(triples[0] ^ mixed(triples[1] ^ mixed(triples[2]))))
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(column[one].view(np.int64)) for column in triples],
                    pa.array(counts),
                ],
                names=["word", "context", "second", "n"],
            )

    counted = (
        rows.mapInArrow(count, "word long, context long, second long, n long")
        .groupBy("word", "context", "second")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > over)
    )
    return {(r["word"], r["context"], r["second"]): r["n"] for r in counted.collect()}


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and its number."""
    _, one, counts = np.unique(keys, return_index=True, return_counts=True)
    return one, counts.astype(np.int64)


def _columns(keys: dict[tuple, int], width: int) -> list[np.ndarray]:
    return [np.array([k[i] for k in keys], dtype=np.int64).view(np.uint64) for i in range(width)]


def _member(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(inside, values), len(inside) - 1)
    return inside[at] == values


def _pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mixed(words) ^ (contexts & _CONTEXT_MASK)


def _triple_keys(words: np.ndarray, contexts: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    return mixed(_pair_keys(words, contexts)) ^ (seconds & _SECOND_MASK)


def _known_counts(
    counts: np.ndarray, keys: np.ndarray, known: np.ndarray, known_counts: np.ndarray
) -> np.ndarray:
    """``counts``, but of the frequent keys, which lie in many parts, what was counted over all."""
    if not len(known):
        return counts
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, known_counts[at], counts)


ROUTED = (
    "part int, block long, words binary, sizes binary, docs binary, low binary, high binary,"
    " second binary, train binary, ids array<{id}>, tokens array<long>"
)
ANSWERED = (
    "block long, docs binary, known binary, base binary, score binary, train binary,"
    " ids array<{id}>, tokens array<long>"
)


@dataclass
class Model:
    """What every task knows: totals, and the frequent words, pairs and triples."""

    tokens: int
    distinct: int
    documents: int
    parts: int
    hot_words: dict[int, int]
    hot_pairs: dict[tuple[int, int], int]
    hot_triples: dict[tuple[int, int, int], int]
    slice_tokens: int

    def __post_init__(self):
        words = np.array([*self.hot_words], dtype=np.int64).view(np.uint64)
        self.words = _sorted(words, self.hot_words)
        self.pairs = _sorted(_pair_keys(*_columns(self.hot_pairs, 2)), self.hot_pairs)
        self.triples = _sorted(_triple_keys(*_columns(self.hot_triples, 3)), self.hot_triples)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.tokens + self.distinct + 1.0)

    def parts_of(self, block: Block, number: int) -> np.ndarray:
        """The word decides; a frequent word spreads by context, a frequent pair by the one
        before, a frequent triple by block."""
        words, contexts, seconds = block.words, block.contexts, block.seconds
        key = words
        if len(self.words[0]):
            often = _member(words, self.words[0])
            key = np.where(often, mixed(words ^ mixed(contexts)), key)
        if len(self.pairs[0]):
            often = _member(_pair_keys(words, contexts), self.pairs[0])
            key = np.where(often, mixed(words ^ mixed(contexts ^ mixed(seconds))), key)
        if len(self.triples[0]):
            often = _member(_triple_keys(words, contexts, seconds), self.triples[0])
            key = np.where(often, mixed(words ^ np.uint64(number)), key)
        return (key % np.uint64(self.parts)).astype(np.int64)


def _sorted(keys: np.ndarray, counts: dict) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], np.array(list(counts.values()), dtype=np.int64)[order]


def _route(model: Model, id_type: pa.DataType):
    """Tokens of whole blocks to the parts of their words."""
    shift = max(1, (model.parts - 1).bit_length())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, block in enumerate(blocks(batches), first):
            part = model.parts_of(block, number)
            order = np.argsort(
                (part.astype(np.uint64) << np.uint64(64 - shift)) | (block.words >> np.uint64(shift)),
                kind="stable",
            )
            words, part = block.words[order], part[order]
            contexts = block.contexts[order] & _CONTEXT_MASK
            seconds = (block.seconds[order] & _SECOND_MASK).astype(np.uint32)
            change = np.flatnonzero((words[1:] != words[:-1]) | (part[1:] != part[:-1])) + 1
            heads = np.concatenate([[0], change])
            sizes = np.diff(np.concatenate([heads, [len(words)]])).astype(np.uint32)
            cuts = np.searchsorted(part, np.arange(model.parts + 1))
            head_cuts = np.searchsorted(part[heads], np.arange(model.parts + 1))
            full = np.flatnonzero(np.diff(cuts))
            tokens = np.bincount(block.rows, minlength=len(block.ids)).astype(np.int64)
            train = np.packbits(block.train).tobytes()
            only = lambda value, kind: pa.array([value] + [None] * (len(full) - 1), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)),
                    pa.array(np.full(len(full), number)),
                    _blobs(words[heads], head_cuts, full),
                    _blobs(sizes, head_cuts, full),
                    _blobs(block.rows[order], cuts, full),
                    _blobs((contexts & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts, full),
                    _blobs((contexts >> np.uint64(32)).astype(np.uint8), cuts, full),
                    _blobs(seconds, cuts, full),
                    pa.array([train] * len(full), pa.binary()),
                    only(block.ids.to_pylist(), pa.list_(id_type)),
                    only(tokens, pa.list_(pa.int64())),
                ],
                names=["part", "block", "words", "sizes", "docs", "low", "high", "second", "train", "ids", "tokens"],
            )

    return work


def _answer(model: Model, id_type: pa.DataType):
    """One part: counts its training tokens, builds its trie, answers all its tokens.

    Rows wait in a nameless file while they are counted, so memory holds narrow arrays of one
    part's tokens. These are taken in slices by their words' hashes, each with a trie of its
    own that is read from its map, so that the wider arrays of counting stay small.
    """
    names = ["block", "docs", "known", "base", "score", "train", "ids", "tokens"]
    columns = {"words": np.uint64, "sizes": np.uint32, "low": np.uint32, "high": np.uint8, "second": np.uint32}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {name: [] for name in (*columns, "train")}
        ends = [0]
        schema = _waiting_schema(id_type)
        with tempfile.TemporaryFile() as file:
            with pa.ipc.new_stream(file, schema) as waiting:
                for batch in batches:
                    kept = batch.select(schema.names).cast(schema)
                    cells = {name: batch.column(name) for name in (*columns, "docs", "train")}
                    for i in range(batch.num_rows):
                        # Views of the batch, which is let go once they are joined.
                        docs = np.frombuffer(cells["docs"][i].as_buffer(), np.uint16)
                        flags = np.unpackbits(np.frombuffer(cells["train"][i].as_buffer(), np.uint8))
                        for name, kind in columns.items():
                            held[name].append(np.frombuffer(cells[name][i].as_buffer(), kind))
                        held["train"].append(flags.astype(bool)[docs])
                        ends.append(ends[-1] + len(docs))
                        waiting.write_batch(kept.slice(i, 1))
            batch = kept = cells = docs = None
            heads, sizes, *tokens = [np.concatenate(held.pop(name)) for name in list(held)]
            pa.default_memory_pool().release_unused()
            sizes = sizes.astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            slices = np.uint64(1 + ends[-1] // model.slice_tokens)
            slice_of = mixed(heads * MULTIPLY_1) % slices
            known = np.zeros(ends[-1], dtype=bool)
            base, score = np.zeros(ends[-1]), np.zeros(ends[-1])
            for number in range(int(slices)):
                own = np.flatnonzero(slice_of == number)
                if len(own):
                    at = ragged_ranges(starts[own], sizes[own])
                    words = np.repeat(heads[own], sizes[own])
                    known[at], base[at], score[at] = _scores(model, words, *[t[at] for t in tokens])
            del heads, sizes, starts, slice_of, tokens
            file.seek(0)
            for a, b, batch in zip(ends[:-1], ends[1:], pa.ipc.open_stream(file)):
                docs = np.frombuffer(batch.column(1)[0].as_buffer(), np.uint16)
                present, inverse = np.unique(docs, return_inverse=True)
                total = [
                    np.bincount(inverse, weights=x[a:b], minlength=len(present))
                    for x in (known, base, score)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([present.tobytes()], pa.binary()),
                        pa.array([total[0].astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([total[1].tobytes()], pa.binary()),
                        pa.array([total[2].tobytes()], pa.binary()),
                        batch.column(2),
                        batch.column(3),
                        batch.column(4),
                    ],
                    names=names,
                )

    return work


def _waiting_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("docs", pa.binary()),
            ("train", pa.binary()),
            ("ids", pa.list_(id_type)),
            ("tokens", pa.list_(pa.int64())),
        ]
    )


def _scores(
    model: Model,
    words: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    second: np.ndarray,
    train: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: known, log10(c + 1), and its share of the model's log10 probability."""
    words, rank = np.unique(words, return_inverse=True)
    counts = np.bincount(rank, weights=train, minlength=len(words)).astype(np.int64)
    counts = _known_counts(counts, words, *model.words)
    contexts = (high.astype(np.uint64) << np.uint64(32)) | low
    pairs, pair_of = np.unique(
        (rank.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts, return_inverse=True
    )
    del contexts
    pair_counts = np.bincount(pair_of, weights=train, minlength=len(pairs)).astype(np.int64)
    pair_rank = (pairs >> np.uint64(CONTEXT_BITS)).astype(np.int64)
    pair_context = pairs & _CONTEXT_MASK
    pair_keys = _pair_keys(words[pair_rank], pair_context)
    pair_counts = _known_counts(pair_counts, pair_keys, *model.pairs)
    triples, triple_of = np.unique(
        (pair_of.astype(np.uint64) << np.uint64(SECOND_BITS)) | second, return_inverse=True
    )
    triple_counts = np.bincount(triple_of, weights=train, minlength=len(triples)).astype(np.int64)
    triple_pair = (triples >> np.uint64(SECOND_BITS)).astype(np.int64)
    triple_second = triples & _SECOND_MASK
    if len(model.triples[0]):
        keys = mixed(pair_keys[triple_pair]) ^ triple_second
        triple_counts = _known_counts(triple_counts, keys, *model.triples)

    prior = PRIOR * model.base(counts)
    backed = PAIR_SHARE * pair_counts + prior[pair_rank]
    trained, paired = np.flatnonzero(counts), np.flatnonzero(pair_counts)
    tripled = np.flatnonzero(triple_counts)
    new_rank, new_place = np.cumsum(counts > 0) - 1, np.cumsum(pair_counts > 0) - 1
    trie = NgramTrie(
        words[trained],
        counts[trained],
        np.log10(prior[trained]),
        np.log10(PAIR_SHARE * counts[trained] + PRIOR),
        (
            new_rank[pair_rank[paired]],
            pair_context[paired],
            np.log10(backed[paired]),
            np.log10(pair_counts[paired] + PAIR_SHARE * counts[pair_rank[paired]] + PRIOR),
        ),
        (
            new_place[triple_pair[tripled]],
            triple_second[tripled],
            np.log10(triple_counts[tripled] + backed[triple_pair[tripled]]),
        ),
    )
    word_place, known = trie.find(words)
    known_place = word_place[known]
    count = np.zeros(len(words))
    count[known] = trie.counts[known_place]
    word_weight = np.full(len(words), np.log10(PRIOR * model.base(np.zeros(1)))[0])
    word_weight[known] = restored(trie.weights[known_place])
    word_follow = np.full(len(words), np.log10(PRIOR))
    word_follow[known] = restored(trie.follows[known_place])
    pair_weight, pair_follow = word_weight[pair_rank], word_follow[pair_rank]
    pair_place = np.zeros(len(pairs), dtype=np.int64)
    asked = np.flatnonzero(known[pair_rank])
    place, hit = trie.pairs.find(word_place[pair_rank[asked]], pair_context[asked])
    at, place = asked[hit], place[hit]
    pair_place[at] = place
    pair_weight[at] = restored(trie.pairs.weights[place])
    pair_follow[at] = restored(trie.pairs.follows[place])
    found = np.zeros(len(pairs), dtype=bool)
    found[at] = True
    weight = pair_weight[triple_pair]
    asked = np.flatnonzero(found[triple_pair])
    place, hit = trie.triples.find(pair_place[triple_pair[asked]], triple_second[asked])
    weight[asked[hit]] = restored(trie.triples.weights[place[hit]])
    trie.close()
    # Nothing follows an end.
    pair_follow[words[pair_rank] == END] = 0.0
    return (
        (count > 0)[rank],
        np.log10(count + 1.0)[rank],
        weight[triple_of] - pair_follow[pair_of],
    )


def score_texts(
    df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's log10 probability under a trigram model learnt from the rows of ``train``.

    p(w | u v) = (c(u, v, w) + s c(v, w) + b p(w)) / (c(u, v) + s c(v) + b), with p(w) =
    (c(w) + 1) / (N + V + 1), s = PAIR_SHARE and b = PRIOR: counts of three orders merged, a
    proper distribution with weights that do not grow with the corpus. The numerator
    depends on w and its contexts, the denominator on v and its context alone, so a
    token is answered where its word is counted and a text's
    score is the sum of the answers. Each token is therefore sent once, packed with its
    block of documents, to its word's part. That part's task counts, builds its shard of
    the trie and answers; partial sums per document go back. No vocabulary is broadcast.

    Words with more than SPREAD_SHARE / parts of all tokens, fewer than ``parts`` /
    SPREAD_SHARE of them, are spread by context, pairs as frequent as that by the context
    before, and triples by block; their counts come to all tasks. So no part is much larger
    than the others, and no slice of one word either.

    NULL texts are empty (one end token); without training rows p is 1 for that token's
    text. Repeated rows and NULL ids are scored like other rows. Other columns are not read.
    Columns: the id, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``.
    """
    rows = df.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        F.coalesce(train, F.lit(False)).alias("__train"),
    )
    id_field = rows.schema["__id"]
    id_sql = id_field.dataType.simpleString()
    id_type = _arrow_type(id_field)
    total = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-total // PART_BYTES)))
    learnt = rows.filter("__train")
    vocab = materialize(vocabulary(learnt, parts), "vocabulary")
    sums = vocab.agg(F.sum("total"), F.sum("distinct")).first()
    tokens, distinct = sums[0] or 0, sums[1] or 0
    over = int(tokens * SPREAD_SHARE / parts)
    hot = frequent_words(vocab, over)
    pairs = frequent_pairs(learnt, hot, over) if hot else {}
    triples = frequent_triples(learnt, pairs, over) if pairs else {}
    documents = learnt.count()
    # Fewer than ``parts`` / SPREAD_SHARE of each order, by arithmetic: each has over that of all.
    shared = df.sparkSession.sparkContext.broadcast(
        (tokens, distinct, documents, parts, hot, pairs, triples, SLICE_TOKENS)
    )
    answers = (
        rows.mapInArrow(_deferred(_route, shared, id_type), ROUTED.format(id=id_sql))
        .groupBy("part")
        .applyInArrow(_deferred(_answer, shared, id_type), ANSWERED.format(id=id_sql))
    )
    begin = float(np.log10(documents + PAIR_SHARE * documents + PRIOR))
    width = float(np.log10(tokens + distinct + 1.0))
    schema = T.StructType([T.StructField(id_col, id_field.dataType)])
    for name, kind in (
        ("train", "boolean"),
        ("n_tokens", "long"),
        ("n_known", "long"),
        ("train_tokens", "long"),
        ("base_score", "double"),
        ("score", "double"),
    ):
        schema = schema.add(name, kind)

    def total_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, about = np.zeros((3, BLOCK_ROWS + 1)), None
        for batch in batches:
            for row in batch.to_pylist():
                docs = np.frombuffer(row["docs"], np.uint16)
                for i, (name, kind) in enumerate(
                    (("known", np.uint32), ("base", np.float64), ("score", np.float64))
                ):
                    sums[i, docs] += np.frombuffer(row[name], kind)
                if row["ids"] is not None:
                    about = row
        count = np.array(about["tokens"], dtype=np.int64)
        n = len(count)
        flags = np.unpackbits(np.frombuffer(about["train"], np.uint8))[:n].astype(bool)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(about["ids"], id_type),
                pa.array(flags),
                pa.array(count),
                pa.array(sums[0, :n].astype(np.int64)),
                pa.array(np.full(n, tokens, dtype=np.int64)),
                pa.array(sums[1, :n] - count * width),
                pa.array(sums[2, :n] - begin),
            ],
            names=schema.names,
        )

    return answers.groupBy("block").applyInArrow(total_of, schema)


def _deferred(make, shared, id_type):
    """A task function that takes the broadcast model when it starts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(Model(*shared.value), id_type)(batches)

    return work


def _arrow_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32 modulo 7 of 2 are held out."""
    docs = load_table(spark, sf_dir, "documents")
    scored = score_texts(docs, crc_class("doc_id", 7) != 2)
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
