"""Near duplicates: SimHash fingerprints with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.components import components
from lodeseek.llm.joins import counted_side
from lodeseek.llm.text import bytes_of, in_parts, lowered, word_runs
from lodeseek.session import load_table, materialize

WORDS, RADIUS, SEGMENTS = 3, 3, 2
# Shingles hashed at a time; bounds the bit table of a very long text.
SHINGLES_AT_ONCE = 1 << 16


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words joined by one space.

    Fewer words make one shingle, none make none.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - (lengths + 1)
    joined = np.full(int(lengths.sum()) + len(lengths), 32, dtype=np.uint8)
    # Words are moved together only where they are not one space apart already.
    where = np.repeat(at - starts, lengths)
    source = np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(
        starts - (np.cumsum(lengths) - lengths), lengths
    )
    joined[source + where] = data[source]
    text = joined.tobytes()
    count = max(1, len(starts) - words + 1)
    begin = at[:count].tolist()
    finish = (at + lengths)[min(words, len(starts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(text[b:e], 42) for b, e in zip(begin, finish)), dtype=np.uint64, count=count
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes; 0 without any."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """(id, ``fingerprint`` as a long) of every row, from its whole text.

    NULL, empty and blank texts have fingerprint 0. Other columns are not read.
    """
    schema = df.select(id_col).schema.add("fingerprint", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in in_parts(whole, "__text"):
                data, offsets = bytes_of(batch.column("__text"))
                data = lowered(data)
                starts, ends, rows = word_runs(data, offsets)
                bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                prints = np.fromiter(
                    (
                        fingerprint(shingle_hashes(data, starts[a:b], ends[a:b], words))
                        for a, b in zip(bounds[:-1], bounds[1:])
                    ),
                    dtype=np.uint64,
                    count=batch.num_rows,
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), pa.array(prints.view(np.int64))], names=schema.names
                )

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        work, schema
    )


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` set, as signed 64-bit values."""
    masks, shell = [0], [0]
    for _ in range(radius):
        shell = [m | 1 << b for m in shell for b in range(m.bit_length(), bits)]
        masks += shell
    return masks


def links_within(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct values of ``fingerprint`` at ``radius`` bits or fewer.

    The 64 bits are split into equal segments. Two fingerprints within the radius are
    within ``radius // segments`` in one segment at least, so the table keeps every
    fingerprint under each of its segments' values, and the query side asks for all values
    in that small ball. Matches are verified on all 64 bits inside the join; a pair found
    over several segments is returned once. Equal fingerprints have been merged before,
    so copies add nothing. Both sides are shuffled and sorted: Spark takes the side of the
    balls for as small as its fingerprints, many times too small, and would broadcast it.
    """
    width = 64 // segments
    masks = ball(width, radius // segments)
    distinct = prints.select("fingerprint").distinct()
    low = (1 << width) - 1
    parts = F.array(
        *[
            F.struct(
                F.lit(s).alias("segment"),
                F.shiftrightunsigned("fingerprint", s * width).bitwiseAND(F.lit(low)).alias("key"),
            )
            for s in range(segments)
        ]
    )
    table = distinct.select(F.col("fingerprint").alias("b"), F.inline(parts))
    probes = distinct.select(F.col("fingerprint").alias("a"), F.inline(parts)).select(
        "a",
        "segment",
        F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"),
        "key",
    ).select("a", "segment", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    close = (F.col("a") < F.col("b")) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    )
    found = probes.alias("p").hint("merge").join(
        table.alias("t"),
        (F.col("p.segment") == F.col("t.segment")) & (F.col("p.key") == F.col("t.key")) & close,
    )
    return found.select("a", "b").distinct()


def near_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, ``fingerprint``, ``root``, ``component_id``) of every row of ``df``.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; a component is
    what links connect, over any number of steps. ``component_id`` is the smallest id in
    it, NULL if none of its rows has an id. Repeated rows and copies have equal
    fingerprints and share a component, as do all texts without words (fingerprint 0). An
    empty table gives an empty result.

    No side of these joins is broadcast: each may have a row for every fingerprint, which in
    memory is some ten times as large as the packed file that Spark sizes it by.
    """
    prints = materialize(fingerprints(df, id_col, text_col, words), "fingerprints")
    roots = components(links_within(prints, radius))
    distinct = prints.groupBy("fingerprint").agg(F.min(id_col).alias("__least"))
    rooted = distinct.hint("merge").join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    named = materialize(
        rooted.hint("merge").join(least, "root").select("fingerprint", "root", "component_id"),
        "components",
    )
    return prints.hint("merge").join(named, "fingerprint").select(
        id_col, "fingerprint", "root", "component_id"
    )


def drop_near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """Rows of ``df`` with all columns, one of every component of `near_groups`: the smallest id's.

    Of rows that share the smallest id, the one with the smallest text digest; of rows
    repeated with id and text, one. Rows without id are kept only where a group has
    no row with one. Dropped rows, the minority, leave by an anti-join on id and text.
    """
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    source = df.select(F.struct(id_col, digest.alias("md5")).alias("__row"), F.col(text_col).alias("__t"))
    groups = materialize(near_groups(source, "__row", "__t", words, radius), "near-groups")
    rank = F.struct(F.col(f"__row.{id_col}").isNull().alias("last"), F.col("__row").alias("row"))
    stays = groups.groupBy("root").agg(
        F.min(rank).alias("__stays"), F.count(F.lit(1)).alias("__size")
    ).filter("__size > 1")
    # Only rows of groups with more than one row can go.
    special = materialize(
        groups.join(stays, "root").select(
            F.col(f"__row.{id_col}").alias("__id"),
            F.col("__row.md5").alias("__md5"),
            F.col("__stays.row").eqNullSafe(F.col("__row")).alias("__kept"),
        ).distinct(),
        "near-special",
    )
    tagged = df.withColumn("__text_md5", digest)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_md5") == F.col("__md5"))
    plain = tagged.join(counted_side(special), same, "left_anti")
    stays = materialize(special.filter("__kept"), "near-stays")
    first = tagged.join(counted_side(stays), same, "left_semi").dropDuplicates(
        [id_col, "__text_md5"]
    )
    return plain.unionByName(first).drop("__text_md5")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = near_groups(load_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
