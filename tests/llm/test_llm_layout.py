import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_data import no_docs, odd_docs, odd_rows
from tokenizers import Tokenizer

from lodeseek.llm.packing import (
    CAPACITY,
    TOKENIZER,
    WASTE,
    UnitTokenizer,
    pack,
    piece_lengths,
    powers_of_two,
)
from lodeseek.llm.sharding import shuffle_into_shards, write_shards

PATH = public_tokenizers.path(TOKENIZER)


def test_shards_are_even_gapless_and_hold_every_row(spark):
    sharded = shuffle_into_shards(odd_docs(spark), 5, bucket_bytes=2000)
    rows = sharded.collect()
    wanted = Counter((i, t) for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, r.text) for r in rows) == wanted
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # The input's own column of that name is replaced.
    assert sharded.columns.count("shard") == 1


def test_shuffle_depends_on_the_seed_only(spark):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")

    def places(df, seed):
        return {r.doc_id: (r["shard"], r.slot) for r in shuffle_into_shards(df, 7, seed=seed, bucket_bytes=9000).collect()}

    first = places(frame, 1)
    assert first == places(frame.repartition(13), 1) != places(frame, 2)
    # Neighbours do not stay together.
    near = sum(first[i][0] == first[i + 1][0] for i in range(2999))
    assert abs(near / 2999 - 1 / 7) < 0.04


def test_shards_of_nothing_and_more_shards_than_rows(spark, tmp_path):
    assert shuffle_into_shards(no_docs(spark), 4).count() == 0
    three = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    sharded = shuffle_into_shards(three, 10)
    assert sorted(r.slot for r in sharded.collect()) == [0, 0, 0]
    write_shards(sharded, str(tmp_path / "shards"))
    assert len([d for d in os.listdir(tmp_path / "shards") if d.startswith("shard=")]) == 3


def test_ids_are_the_library_s_own():
    tokenizer, own = Tokenizer.from_file(PATH), UnitTokenizer(PATH)
    texts = [t for _, t, *_ in odd_rows()] + [
        "The don't CAN'T it's 's 12,345.67$ a_b-c",
        "<|startoftext|> x <|ENDOFTEXT|> y<|endoftext|>z <|",
        "é É Ê ß ×÷ İstanbul ſ ΣΑΣ é äb ½ ² ª «oui»",
        "\x00\x1c a\x85b c d ﬁ Ǆ <a|b | |>",
    ]
    rng = np.random.default_rng(3)
    letters = list("aB é'É1 2.,<|>ñ×́İ \n\x1csSÿ")
    texts += ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    for _ in range(2):  # the second time from memory
        ids, offsets = own.texts(pa.array(texts))
        for text, a, b in zip(texts, offsets, offsets[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1, 2, 31, 63, 64, 100, 682, 683, 1000, 1024, 1025, 1500, 2047, 2048, 2049, 9999])
def test_pieces_cover_a_text_and_fill_their_bins(length):
    pieces = piece_lengths(length)
    assert sum(pieces) == length and min(pieces) > 0
    for piece in pieces:
        k = CAPACITY // piece
        assert CAPACITY - k * piece <= max(WASTE * CAPACITY, k)
    assert sum(powers_of_two(length, CAPACITY)) == length


def test_packing_round_trip(spark):
    packed = pack(odd_docs(spark), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    wanted = Counter(
        (i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in odd_rows()
    )
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length == len(r.ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for (i, ids), copies in wanted.items():
        mine = [r for r in pieces[i] if r.doc_tokens == len(ids)]
        covered = Counter(p for r in mine if tuple(r.ids) == ids[r.start : r.start + r.length] for p in range(r.start, r.start + r.length))
        assert all(covered[p] >= copies for p in range(len(ids)))
    assert sum(r.length for r in packed) == sum(len(ids) * n for (_, ids), n in wanted.items())
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
        padding += 0 if at & (at - 1) == 0 else CAPACITY - at
    assert padding <= sum(r.length for r in packed) * WASTE
    assert pack(no_docs(spark), PATH).count() == 0
