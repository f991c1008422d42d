"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.text import bytes_of, crc_class, in_parts, ragged_ranges
from lodeseek.session import load_table

PROFILE = 400
# Distances of texts to languages that are held at a time.
TOTALS_HELD = 4 << 20
UNKNOWN = "und"
_BOUNDARY = np.uint64(0x5F)


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65,536 code points: whether it is a letter, and its lower case."""
    letters = np.zeros(1 << 16, dtype=bool)
    lower = np.arange(1 << 16, dtype=np.uint16)
    for code in range(1 << 16):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            letters[code] = True
            small = char.lower()
            if len(small) == 1 and ord(small) < 1 << 16:
                lower[code] = ord(small)
    return letters, lower


def _code_points(column: pa.Array, tables: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points, row offsets and which of them are letters.

    Letters beyond the first plane share the codes of the private area.
    """
    data, offsets = bytes_of(column)
    # A line end after every row, so that its last word has an edge too.
    data = np.insert(data, offsets[1:], 10)
    offsets = offsets + np.arange(len(offsets))
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    letters, lower = tables
    small = np.minimum(codes, 0xFFFF)
    is_letter, result = letters[small], lower[small].astype(np.uint64)
    for at in np.flatnonzero(codes > 0xFFFF).tolist():
        char = chr(int(codes[at]))
        is_letter[at] = unicodedata.category(char)[0] == "L"
        result[at] = 0xE000 + ord(char.lower()) % 6400
    return result, leads[offsets], is_letter


def ngram_counts(column: pa.Array, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (row in the upper 16 bits, n-gram below) and counts of a text column.

    N-grams are one to three letters of a word, the longer ones with its edges. Every
    letter of every row counts.
    """
    codes, offsets, letter = _code_points(column, tables)
    rows = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(offsets)) << np.uint64(48)
    keep = letter.copy()
    # One edge before each word and one after it: the place next to a letter.
    after = np.zeros(len(codes), dtype=bool)
    after[1:] = letter[:-1] & ~letter[1:]
    keep |= after
    first = np.zeros(len(codes), dtype=bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    codes = np.where(letter, codes, _BOUNDARY)[keep]
    rows, letter, first = rows[keep], letter[keep], first[keep]
    # A text begins with an edge too, so that its first word looks like any other.
    same = np.zeros(len(codes), dtype=bool)
    same[1:] = rows[1:] == rows[:-1]
    before = np.full(len(codes), _BOUNDARY)
    before[1:] = np.where(same[1:], codes[:-1], _BOUNDARY)
    pairs = rows | before << np.uint64(16) | codes
    three = np.flatnonzero(same & (np.arange(len(codes)) >= 1))
    triples = rows[three] | before[three - 1] << np.uint64(32) | codes[three - 1] << np.uint64(16) | codes[three]
    # The middle of three is inside a word.
    triples = triples[letter[three - 1]]
    pairs = pairs[letter | (same & (before != _BOUNDARY))]
    keys = np.concatenate([rows[letter] | codes[letter], pairs, triples])
    keys.sort()
    return _run_lengths(keys)


def _run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def language_profiles(
    df: DataFrame, text_col: str, lang_col: str, size: int = PROFILE
) -> list[tuple[str, int, int]]:
    """(language, n-gram, rank from 0) of each language's ``size`` most frequent n-grams.

    Counts run over all rows with text and language; a task adds up its batches before the
    shuffle. Ties go to the smaller n-gram code.
    """
    tables = letter_tables()
    rows = df.select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).filter(
        "__text IS NOT NULL AND __lang IS NOT NULL"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                for at in range(0, batch.num_rows, 60_000):
                    part = batch.slice(at, 60_000)
                    keys, counts = ngram_counts(part.column("__text"), tables)
                    langs = np.array(part.column("__lang").to_pylist(), dtype=object)
                    owner = langs[(keys >> np.uint64(48)).astype(np.int64)]
                    grams = keys & np.uint64((1 << 48) - 1)
                    for lang in set(langs.tolist()):
                        mine = owner == lang
                        old = totals.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                        distinct, inverse = np.unique(
                            np.concatenate([old[0], grams[mine]]), return_inverse=True
                        )
                        weights = np.concatenate([old[1], counts[mine]])
                        totals[lang] = (
                            distinct,
                            np.bincount(inverse, weights=weights, minlength=len(distinct)).astype(np.int64),
                        )
        for lang, (grams, counts) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(grams), pa.string()),
                    pa.array(grams.view(np.int64)),
                    pa.array(counts),
                ],
                names=["lang", "gram", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # Said this way Spark keeps ``size`` n-grams of a language in every task before the shuffle.
    best = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    return [(r.lang, r.gram, r.place - 1) for r in best.select("lang", "gram", "place").collect()]


def identify(
    df: DataFrame, profiles: list[tuple[str, int, int]], text_col: str = "text", size: int = PROFILE
) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, from the whole text alone.

    The text's ``size`` most frequent n-grams are ranked; every one adds how far out of
    place its rank is in a language's profile, or ``size`` if it is not there. The language
    with the least sum is predicted (ties: the first by name); ``score`` is 1 less the
    mean distance over ``size``. A text that is NULL or has no letter is ``und`` with score
    0, as is every text if there are no profiles. Columns with these names are replaced.
    """
    df = df.drop("lang_pred", "score", "__text")
    tables = letter_tables()
    names = sorted({p[0] for p in profiles})
    grams = np.array(sorted({p[1] for p in profiles}), dtype=np.int64).view(np.uint64)
    grams.sort()
    # Per n-gram, the languages that have it in their profile, and at which rank.
    number = {name: n for n, name in enumerate(names)}
    entries = np.array(sorted(
        (int(np.searchsorted(grams, np.array(gram, np.int64).view(np.uint64))), number[lang], rank)
        for lang, gram, rank in profiles
    ), dtype=np.int64).reshape(-1, 3)
    bounds = np.searchsorted(entries[:, 0], np.arange(len(grams) + 2))
    rows_at_once = max(1, min(60_000, TOTALS_HELD // max(1, len(names))))
    columns = df.columns
    schema = T.StructType([*df.schema.fields]).add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in in_parts(whole, "__text"):
                for at in range(0, part.num_rows, rows_at_once):
                    batch = part.slice(at, rows_at_once)
                    best, score = predict(batch.column("__text"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c) for c in columns],
                            pa.array([names[b] if b >= 0 else UNKNOWN for b in best.tolist()]),
                            pa.array(score),
                        ],
                        names=schema.names,
                    )

    def predict(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = ngram_counts(column, tables)
        n = len(column)
        best, score = np.full(n, -1), np.zeros(n)
        if not len(keys) or not names:
            return best, score
        row = (keys >> np.uint64(48)).astype(np.int64)
        # Within a row by falling count, ties by code: the position breaks them.
        if counts.max() < 1 << 23 and len(keys) < 1 << 25:
            falling = np.uint64((1 << 23) - 1) - counts.astype(np.uint64)
            order = (keys >> np.uint64(48) << np.uint64(48)) | falling << np.uint64(25)
            order |= np.arange(len(keys), dtype=np.uint64)
            order.sort()
            at = (order & np.uint64((1 << 25) - 1)).astype(np.int64)
        else:
            # The same for texts whose counts or n-grams are too many for one word each.
            at = np.lexsort((np.arange(len(keys)), -counts, row))
        begin = np.searchsorted(row, np.arange(n))
        rank = np.arange(len(keys)) - begin[row]
        top = rank < size
        at, rank, row = at[top], rank[top], row[top]
        gram = keys[at] & np.uint64((1 << 48) - 1)
        place = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        place = np.where(grams[place] == gram, place, len(grams))
        # Out of place by ``size`` in every language, but for those that have the n-gram.
        having = bounds[place + 1] - bounds[place]
        found = ragged_ranges(bounds[place], having)
        nearer = size - np.abs(entries[found, 2] - np.repeat(rank, having))
        cell = np.repeat(row, having) * len(names) + entries[found, 1]
        saved = np.bincount(cell, weights=nearer, minlength=n * len(names)).reshape(n, len(names))
        sizes = np.bincount(row, minlength=n)
        total = size * sizes[:, None] - saved
        used = np.flatnonzero(sizes)
        best[used] = total[used].argmin(axis=1)
        score[used] = 1.0 - total[used].min(axis=1) / (sizes[used] * size)
        return best, score

    return df.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(work, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; crc32 modulo 3 of 1 is held out."""
    docs = load_table(spark, sf_dir, "documents")
    held_out = crc_class("doc_id", 3) == 1
    profiles = language_profiles(docs.filter(~held_out), "text", "lang")
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
