"""Benchmark decontamination by canonical templates and slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm.joins import counted_side
from lodeseek.llm.text import MULTIPLY_1, bytes_of, hash_runs, in_parts, lowered, mixed, ragged_ranges
from lodeseek.session import load_table, materialize

WINDOW, SHORTEST = 8, 4
# A window needs this share of plain words; placeholders alone say nothing.
LITERAL_SHARE = 0.5
# A text holds an item when it holds this share of the item's windows.
THRESHOLD = 0.5
# A passage of so many tokens is a leak, whatever share of a long item it is.
RUN = 50
# How items and texts are read: as templates; as templates in which capitalised words that
# open a sentence are names too; and word by word, without placeholders.
TEMPLATE, OPENERS, RAW = 0, 1, 2
# The window filter that goes to all tasks has SPARE bits for every window of the benchmark, but
# no less and no more than these powers of two (32 MB); a fuller one lets more windows pass.
LEAST_FILTER, MOST_FILTER, SPARE = 16, 28, 256
# Benchmarks up to this many windows are sent to the tasks that join.
BROADCAST_WINDOWS = 200_000

# Units of measure that follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml cl l s ms min mins h hr hrs hour hours minute "
    "minutes second seconds day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound "
    "pounds ounce ounces liter liters litre litres dollar dollars cent cents euro euros percent "
    "degrees degree mph kmh w kw v hz gb mb kb"
).split()

# Numbers as words. "One" is left out, as it mostly is none.
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
    "thousand million"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(n) for n in (11, 12, 13))
_DIGIT, _LETTER = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER
_STOPS = np.zeros(256, dtype=bool)
_STOPS[list(b".!?:\n")] = True


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hash_runs(data, ends - [len(w) for w in words], ends))


_UNIT_HASHES = _hash_words(UNITS)
_NUMBER_HASHES = _hash_words(NUMBER_WORDS)
# Capitals among the code points of two bytes: Latin, Greek, Cyrillic, Armenian.
_CAPITALS = np.array([chr(c).isupper() for c in range(0x800)])


# Scripts written without spaces, and punctuation beyond ASCII, as ranges of code points.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
)
_MARKS = ((0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _within(codes: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.any([(codes >= low) & (codes <= high) for low, high in ranges], axis=0)


def _split_scripts(data: np.ndarray, kind: np.ndarray, change: np.ndarray) -> None:
    """Characters of unspaced scripts become tokens of their own, punctuation becomes none."""
    two = np.flatnonzero(data[:-1] == 0xC2)
    # Of U+0080 to U+00BF only the two ordinal signs and the micro sign are letters.
    two = two[~np.isin(data[two + 1], (0xAA, 0xB5, 0xBA))]
    three = np.flatnonzero(data[:-2] >> 4 == 0xE)
    wide = data[three].astype(np.int64)
    codes = (wide & 15) << 12 | (data[three + 1].astype(np.int64) & 63) << 6 | (data[three + 2] & 63)
    marks = three[_within(codes, _MARKS)]
    for at, size in ((two, 2), (marks, 3)):
        for k in range(size):
            kind[at + k] = 0
    alone = three[_within(codes, _UNSPACED)]
    # Ideographs beyond the first plane: U+20000 and up.
    four = np.flatnonzero((data[:-3] == 0xF0) & (data[1:-2] >= 0xA0))
    for at, size in ((alone, 3), (four, 4)):
        change[at] = True
        change[at + size] = True


def templates(
    column: pa.Array, form: int = TEMPLATE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: row, template symbol, and filler (0 for a plain word).

    Tokens are numbers (with inner points and commas) and runs of letters. A number, in
    digits or as one of NUMBER_WORDS, is a number placeholder; a unit word after a number is a unit; a word with
    a capital (of an alphabet of up to two bytes) that does not begin a sentence is a name; other words stand
    for themselves, with A-Z in lower case. The lowest bit of a filler tells names.
    In the form OPENERS such a word at the beginning of a sentence is a name too, and in the
    form RAW every token stands for itself; in both, characters of scripts without spaces
    are tokens, and punctuation beyond ASCII separates.
    """
    data, offsets = bytes_of(column)
    kind = _CLASS[data]
    if len(data) > 2:
        inner = (data[1:-1] == 44) | (data[1:-1] == 46)
        inner &= (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT)
        kind[1:-1][inner] = _DIGIT
    starts_row = np.zeros(len(data) + 1, dtype=bool)
    starts_row[offsets[:-1]] = True
    change = np.ones(len(data) + 1, dtype=bool)
    if form != TEMPLATE and len(data) > 3:
        change[:] = False
        _split_scripts(data, kind, change)
        change[[0, -1]] = True
        change[1:-1] |= kind[1:] != kind[:-1]
    else:
        change[1:-1] = kind[1:] != kind[:-1]
    change |= starts_row
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    rows = np.searchsorted(offsets, starts, "right") - 1
    small = lowered(data)
    hashes = hash_runs(small, starts, ends)
    if form == RAW:
        return rows, hashes, np.zeros(len(hashes), dtype=np.uint64)
    number = (kind[starts] == _DIGIT) | _among(hashes, _NUMBER_HASHES)
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(data) else first
    wide = (first >= 0xC2) & (first <= 0xDF)
    code = np.where(wide, (first.astype(np.int64) & 31) << 6 | (second & 63), first)
    capital = (wide | (first < 128)) & _CAPITALS[np.minimum(code, 0x7FF)]
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
    before = np.concatenate([[0], ends[:-1]])
    opens = stops[starts] > stops[before]
    opens |= np.concatenate([[-1], rows[:-1]]) != rows
    after_number = np.concatenate([[False], number[:-1]]) & ~(
        np.concatenate([[-1], rows[:-1]]) != rows
    )
    unit = after_number & ~number & _among(hashes, _UNIT_HASHES)
    name = capital & ~unit & ~number
    if form == TEMPLATE:
        name &= ~opens
    symbol = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, hashes)))
    filler = np.where(number | unit | name, (hashes & ~np.uint64(1)) | name.astype(np.uint64), np.uint64(0))
    return rows, symbol, filler


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def windows(
    rows: np.ndarray, symbol: np.ndarray, filler: np.ndarray, size: int, form: int = TEMPLATE
):
    """Starts and hashes of all windows of ``size`` symbols that have enough plain words.

    In the form RAW all words are plain. Windows of different forms have different hashes.
    """
    n = len(rows) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = (total ^ symbol[k : k + n]) * MULTIPLY_1
        total ^= total >> np.uint64(32)
    plain = np.concatenate([[0], np.cumsum(filler == 0)])
    good = (rows[:n] == rows[size - 1 :]) & (plain[size:] - plain[:n] >= size * LITERAL_SHARE)
    at = np.flatnonzero(good)
    return at, mixed(total[at] + np.uint64(form))


def _lists(values: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """Fillers of each window as a list column."""
    flat = values[ragged_ranges(at, np.full(len(at), size, dtype=np.int64))]
    ends = np.arange(len(at) + 1, dtype=np.int32) * size
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def benchmark_windows(
    items: DataFrame, id_col: str, text_col: str, forms: tuple[int, ...] = (TEMPLATE,)
) -> DataFrame:
    """(item, place, hash, fillers, size, windows, form, whole) of every item's windows.

    ``windows`` counts those of the form, ``whole`` all that the item's tokens make.

    An item of fewer than WINDOW tokens is one window of its own length. Below SHORTEST tokens it
    cannot be told from chance within a text, so it is a window in the form RAW only, for texts
    that are nothing else. Items without a token and items with NULL id are left out.
    """
    schema = T.StructType([T.StructField("item", items.schema[id_col].dataType)])
    for name, kind in (("place", "long"), ("hash", "long")):
        schema = schema.add(name, kind)
    schema = schema.add("item_fillers", T.ArrayType(T.LongType())).add("size", "integer").add(
        "windows", "long"
    ).add("form", "integer").add("whole", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__id")
            for form in forms:
                rows, symbol, filler = templates(batch.column("__text"), form)
                cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    size = min(WINDOW, b - a)
                    if not size or (size < SHORTEST and form != RAW):
                        continue
                    at, hashes = windows(rows[a:b], symbol[a:b], filler[a:b], size, form)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i].as_py()] * n, ids.type),
                            pa.array(at),
                            pa.array(hashes.view(np.int64)),
                            _lists(filler[a:b], at, size if form != RAW else 0),
                            pa.array(np.full(n, size, dtype=np.int32)),
                            pa.array(np.full(n, n, dtype=np.int64)),
                            pa.array(np.full(n, form, dtype=np.int32)),
                            pa.array(np.full(n, b - a - size + 1, dtype=np.int64)),
                        ],
                        names=schema.names,
                    )

    named = items.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return materialize(
        named.filter("__id IS NOT NULL").mapInArrow(work, schema), "benchmark-windows"
    )


def _alignments(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str,
    item_id: str,
    item_text: str,
    forms: tuple[int, ...],
) -> DataFrame:
    """(``text_md5``, ``item``, ``form``, ``places``, ``windows``, ``whole``, ``size``, ``differs``)
    of the alignments whose fillers correspond, windows met in a hash join: a filler of the item
    stands for one filler of the text throughout, and two names never for one; two numbers or units
    may, as other parameters can be equal by chance."""
    bench = benchmark_windows(benchmark, item_id, item_text, forms)
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())
    count = bench.count()
    power = min(MOST_FILTER, max(LEAST_FILTER, int(np.ceil(np.log2(max(count, 1) * SPARE)))))
    mask = np.uint64((1 << power) - 1)
    # One row per 64 bits of the filter that has any set, however large the benchmark is.
    place = F.col("hash").bitwiseAND(F.lit(int(mask)))
    words = bench.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 AS int))")).alias("bits")
    ).toArrow()
    packed = np.zeros(1 << (power - 6), dtype=np.int64)
    packed[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(packed.view(np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                for form in forms:
                    found = templates(batch.column("__text"), form)
                    for size in sizes:
                        rows, symbol, filler = found
                        if size < SHORTEST:
                            if form != RAW:
                                continue
                            # Texts that are nothing but so many tokens.
                            alone = np.bincount(rows, minlength=batch.num_rows)[rows] == size
                            rows, symbol, filler = rows[alone], symbol[alone], filler[alone]
                        begin = np.searchsorted(rows, np.arange(batch.num_rows))
                        at, hashes = windows(rows, symbol, filler, size, form)
                        spot = hashes & mask
                        near = (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
                        at, hashes = at[near], hashes[near]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("__md5").take(pa.array(rows[at])),
                                pa.array(at - begin[rows[at]]),
                                pa.array(hashes.view(np.int64)),
                                _lists(filler, at, size if form != RAW else 0),
                            ],
                            names=["text_md5", "at", "hash", "fillers"],
                        )

    texts = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    ).withColumn("__md5", F.md5("__text"))
    found = texts.mapInArrow(
        work, "text_md5 string, at long, hash long, fillers array<long>"
    ).dropDuplicates(["text_md5", "at", "hash"])
    bench = counted_side(bench, BROADCAST_WINDOWS)
    pairs = F.arrays_zip(F.col("item_fillers").alias("i"), F.col("fillers").alias("d"))
    aligned = (
        found.join(bench, "hash")
        .withColumn("shift", F.col("at") - F.col("place"))
        .groupBy("text_md5", "item", "form", "shift")
        .agg(
            F.collect_set("place").alias("places"),
            F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"),
            F.max("windows").alias("windows"),
            F.max("whole").alias("whole"),
            F.max("size").alias("size"),
        )
    )
    names = F.filter("slots", lambda p: p["i"].bitwiseAND(F.lit(1)) == 1)
    one_way = F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))) == F.size("slots")
    both_ways = F.size(F.array_distinct(F.transform(names, lambda p: p["d"]))) == F.size(names)
    differs = F.exists("slots", lambda p: p["i"] != p["d"])
    return aligned.filter(one_way & both_ways).withColumn("differs", differs)


def held_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(``text_md5``, ``item``, ``share``, ``reparameterised``) of texts that hold an item in any form.

    Whole texts and items become templates; windows of them meet in a hash join. A filter
    made of the benchmark's hashes lets only possible matches leave the scan, so nearly all
    windows stay where they are read. Matches of a text and an item at one distance form an
    alignment; it counts if its fillers correspond (`_alignments`). A text holds an item when
    the counting alignments cover THRESHOLD of its windows.

    Each is read in three forms: as a template; with capitalised words that open a sentence
    as names too; and word by word, so that windows of equal words count whatever they are
    made of and however other windows were changed. A text also holds an
    item when it has RUN tokens of it one after another, though ``share`` be less.
    ``reparameterised`` tells that fillers differ where the words alone are not enough. Equal texts
    give one result; texts that are NULL, empty or without tokens hold nothing.
    """
    aligned = _alignments(docs, benchmark, text_col, item_id, item_text, (TEMPLATE, OPENERS, RAW))
    # In a run, place less index is constant, so it is equal RUN windows apart.
    long = F.greatest(F.lit(RUN) - F.col("size"), F.lit(0))
    steps = F.transform(F.sort_array("places"), lambda p, i: p - i)
    run = (F.col("form") != TEMPLATE) & (F.size("places") > long) & (F.col("size") == WINDOW)
    run = run & F.exists(
        F.arrays_zip(steps.alias("s"), F.slice(steps, long + 1, F.size("places")).alias("e")),
        lambda p: p["s"] == p["e"],
    )

    def of(form: int, column: str) -> Column:
        return F.when(F.col("form") == form, F.col(column))

    def places(form: int) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(of(form, "places"))))

    def part(hits: Column, total: str) -> Column:
        return F.coalesce(F.size(hits) / F.col(total), F.lit(0.0))

    both = F.array_union("p1", "p2")
    return (
        aligned.withColumn("run", run)
        .groupBy("text_md5", "item")
        .agg(
            *[places(f).alias(f"p{f}") for f in (TEMPLATE, OPENERS, RAW)],
            *[F.max(of(f, "windows")).alias(f"w{f}") for f in (TEMPLATE, OPENERS, RAW)],
            *[F.coalesce(F.max(of(f, "differs")), F.lit(False)).alias(f"d{f}") for f in (TEMPLATE, OPENERS)],
            F.coalesce(F.max(of(RAW, "run")), F.lit(False)).alias("raw_run"),
            F.max("run").alias("run"),
            F.max(F.when(F.col("form") != TEMPLATE, F.col("whole"))).alias("whole"),
        )
        .withColumn("as_template", part(F.col("p0"), "w0"))
        .withColumn("as_words", part(F.col("p2"), "w2"))
        .withColumn("share", F.greatest("as_template", "as_words", part(F.col("p1"), "w1"), part(both, "whole")))
        .filter((F.col("share") >= THRESHOLD) | F.col("run"))
        .select(
            "text_md5",
            "item",
            "share",
            F.when(F.col("as_template") >= THRESHOLD, F.col("d0"))
            .when((F.col("as_words") >= THRESHOLD) | F.col("raw_run"), F.lit(False))
            .otherwise(F.col("d0") | F.col("d1"))
            .alias("reparameterised"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark item, with all columns."""
    held = held_items(docs, benchmark, text_col).select("text_md5").distinct()
    held = materialize(held.select(F.col("text_md5").alias("__held")), "contaminated")
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(counted_side(held), digest == F.col("__held"), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document whether it holds benchmark items, and which."""
    docs = load_table(spark, sf_dir, "documents")
    found = held_items(docs, load_table(spark, sf_dir, "benchmark"))
    per_text = materialize(
        found.groupBy("text_md5").agg(
            F.sort_array(F.collect_set("item")).alias("item_ids"),
            F.max("share").alias("share"),
            F.max("reparameterised").alias("reparameterised"),
        ),
        "contaminated",
    )
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    return keyed.join(per_text, "text_md5", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )
