"""The built-in embedder: signed feature hashing of tokens.

Token ``w`` with number ``h`` (first 32 bits of its MD5 digest) adds +1 or -1 to
component ``h % dims``; the sign is that of bit ``h div dims``. It needs no model files
and no shuffle: the JVM splits the text into tokens, an Arrow batch of token lists is
counted into one matrix.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import CELLS_AT_ONCE, from_matrix, row_ranges, unit_rows
from lodeseek.functions.text import tokens


# Tokens whose numbers, places and signs are held at a time.
TOKENS_AT_ONCE = 1 << 18


def _encoded(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a batch's distinct tokens, each hashed once, and which of them each token is."""
    encoded = words.dictionary_encode()
    distinct = encoded.dictionary
    numbers = np.fromiter(
        (
            int.from_bytes(md5(word.encode()).digest()[:4], "big")
            for first in range(0, len(distinct), TOKENS_AT_ONCE)
            for word in distinct.slice(first, TOKENS_AT_ONCE).to_pylist()
        ),
        dtype=np.int64,
        count=len(distinct),
    )
    return numbers, encoded.indices.to_numpy()


def _token_numbers(words: pa.Array) -> np.ndarray:
    """Token numbers of a batch."""
    numbers, which = _encoded(words)
    return numbers[which] if len(words) else numbers


def token_ids(words: Column) -> Column:
    """The number of each token of a list."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def number(token_lists: pa.Array) -> pa.Array:
        values = pa.array(_token_numbers(token_lists.flatten()), pa.int64())
        offsets = np.zeros(len(token_lists) + 1, dtype=np.int32)
        np.cumsum(token_lists.value_lengths().fill_null(0), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=token_lists.is_null())

    return number(words)


def token_vectors(token_lists: pa.Array, dims: int) -> pa.Array:
    """Unit vectors of a batch of token lists."""
    counts = np.asarray(token_lists.value_lengths().fill_null(0))
    ends = np.cumsum(counts)
    numbers, which = _encoded(token_lists.flatten())
    vectors = np.empty((len(token_lists), dims), dtype=np.float32)
    # A few rows at a time, so that their matrix stays in the processor's cache, and few tokens.
    for some in row_ranges(counts, TOKENS_AT_ONCE, CELLS_AT_ONCE // dims):
        lengths = counts[some]
        own = numbers[which[ends[some.start] - lengths[0] : ends[some.stop - 1]]]
        signs = np.where((own // dims) % 2 == 0, 1.0, -1.0)
        cells = np.repeat(np.arange(len(lengths)), lengths) * dims + own % dims
        matrix = np.bincount(cells, weights=signs, minlength=len(lengths) * dims)
        vectors[some] = unit_rows(matrix.reshape(-1, dims))
    return from_matrix(vectors, ~np.asarray(token_lists.is_null()))


def hash_embed(text: Column, dims: int, max_length: int | None = None) -> Column:
    """Unit vector of ``dims`` components, of all tokens unless ``max_length`` limits them.

    A text without tokens gives zeros.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(token_lists: pa.Array) -> pa.Array:
        return token_vectors(token_lists, dims)

    return embed(tokens(text, max_length))
