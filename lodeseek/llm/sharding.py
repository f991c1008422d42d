"""Random shards of equal row count by a two-pass external shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.session import load_table, materialize

# What one task holds of one bucket, about.
BUCKET_BYTES = 32 << 20
ROW_BYTES = 16


def row_bytes(text_col: str) -> Column:
    """UTF-8 bytes of the text (NULL: none) and 16 for the rest of the row."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES


def _scattered_repeats(df: DataFrame, key: Column, text_col: str, seed: int, bucket_bytes: int) -> DataFrame:
    """``df`` with ``__key``: ``key``, but of a row repeated very often another one for each copy.

    Equal rows are interchangeable, so they are counted before the shuffle and numbered
    anew; key and number together scatter them. A row counts as repeated very often when
    the rows of its key exceed an eighth of a bucket; there are at most eight such keys per
    bucket. No task takes more copies than that eighth at a time.
    """
    keyed = df.withColumn("__key", key)
    most = max(1, bucket_bytes // 8)
    often = materialize(
        keyed.groupBy("__key")
        .agg(F.count(F.lit(1)).alias("__count"), F.sum(row_bytes(text_col)).alias("__bytes"))
        .filter((F.col("__count") > 1) & (F.col("__bytes") > most))
        .select("__key"),
        "repeated-rows",
    )
    if not often.take(1):
        return keyed
    # Rows that only share the key are told apart here.
    counted = keyed.join(F.broadcast(often), "__key", "left_semi").groupBy("__key", *df.columns).agg(
        F.count(F.lit(1)).alias("__count")
    )
    step = F.greatest(F.lit(1), F.lit(most) / row_bytes(text_col)).cast("long")
    blocks = (
        counted.withColumn("__step", step)
        .withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1, F.col("__step"))))
        .withColumn("__to", F.least("__count", F.col("__from") + F.col("__step")) - 1)
        .repartition("__key", "__from")
    )
    copies = blocks.withColumn("__copy", F.explode(F.sequence("__from", "__to")))
    numbered = copies.withColumn("__key", F.xxhash64("__key", "__copy", F.lit(seed)))
    rest = keyed.join(F.broadcast(often), "__key", "left_anti")
    return rest.unionByName(numbered.select(*rest.columns))


def shuffle_into_shards(
    df: DataFrame,
    shards: int,
    text_col: str = "text",
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 in its shard).

    Pass one scatters rows over buckets by a seeded hash of all their columns, and of a
    number of the copy where equal rows are very many, so that no source, key or group of
    copies gathers in a bucket; there are as many buckets as keep
    one within ``bucket_bytes``. Pass two takes each bucket in one task, puts it in a fixed
    order and permutes it by Fisher-Yates under a seed of its own. The buckets one after
    another are a random permutation of the table; it is cut into ``shards`` stretches
    whose row counts differ by one at most. A task that is lost and run again yields the
    same rows at the same places.

    The driver sees one count per bucket. Rows with NULL anywhere are rows like others; of
    an empty table nothing is returned. Repeated rows are interchangeable. Columns of ``df`` named ``shard`` or ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashable])
    total = df.agg(F.sum(row_bytes(text_col))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    keyed = _scattered_repeats(df, key, text_col, seed, bucket_bytes).withColumn(
        "__bucket", F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(buckets)).cast("int")
    )
    counts = np.zeros(buckets, dtype=np.int64)
    for row in keyed.groupBy("__bucket").count().collect():
        counts[row["__bucket"]] = row["count"]
    before = np.cumsum(counts) - counts
    rows = int(counts.sum())
    schema = T.StructType(
        [*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )
    columns = df.columns
    # One long per bucket of at least bucket_bytes; a broadcast is fetched once per executor.
    shared = df.sparkSession.sparkContext.broadcast(before)

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        numbers = table.column("__bucket").to_numpy()
        keys = table.column("__key").to_numpy()
        for bucket in np.unique(numbers):
            mine = np.flatnonzero(numbers == bucket)
            mine = mine[np.argsort(keys[mine], kind="stable")]
            mine = mine[np.random.default_rng([seed, int(bucket)]).permutation(len(mine))]
            place = int(shared.value[bucket]) + np.arange(len(mine), dtype=np.int64)
            shard = place * shards // rows
            slot = place - -(-shard * rows // shards)
            taken = table.select(columns).take(mine)
            taken = taken.append_column("shard", pa.array(shard.astype(np.int32)))
            yield from taken.append_column("slot", pa.array(slot)).to_batches(max_chunksize=2000)

    return keyed.repartitionById(buckets, F.col("__bucket")).mapInArrow(permuted, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder per shard; the rows of a shard lie in ``slot`` order by file and row."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    docs = load_table(spark, sf_dir, "documents")
    sharded = shuffle_into_shards(docs, 40)
    return sharded.select(
        "doc_id",
        row_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
