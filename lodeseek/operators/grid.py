"""Every split of a table against all rows of another one, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.session import materialize

# What a task does with the rows of a split: it is given them once, and returns
# what answers one block of the other table after another.
Worker = Callable[[pa.Table], Callable[[pa.Table], Iterator[pa.RecordBatch]]]


def against_blocks(
    documents: DataFrame,
    queries: DataFrame,
    splits: int,
    spread: Column,
    work: Worker,
    schema: T.StructType,
) -> DataFrame:
    """What ``work`` yields for every split of ``documents`` and every block of ``queries``.

    ``documents`` are dealt over ``splits`` tasks by ``spread``, a hash of them. A task holds
    the rows of its split, so choose ``splits`` by their bytes; the queries come to it one
    Arrow batch after another from the shuffle. Neither the driver nor the plan grows with
    the queries, and of them a task holds a batch (`spark.sql.execution.arrow.maxRecordsPerBatch`
    rows). A lost task is run again from the shuffle files. A split without documents or
    without queries yields nothing.
    """
    doc_type, query_type = documents.schema, queries.schema
    number = F.pmod(spread, F.lit(splits)).cast("int")
    held = documents.select(
        number.alias("__split"),
        F.struct(*documents.columns).alias("__document"),
        F.lit(None).cast(query_type).alias("__query"),
    )
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("__split"),
        F.lit(None).cast(doc_type).alias("__document"),
        F.struct(*queries.columns).alias("__query"),
    )
    dealt = (
        held.unionByName(asked)
        .repartitionById(splits, F.col("__split"))
        .sortWithinPartitions("__split", F.col("__query").isNotNull())
    )

    return dealt.mapInArrow(_meeting(work), schema)


def beside(
    held: DataFrame,
    rows: DataFrame,
    key: str,
    work: Worker,
    schema: T.StructType,
    spread: Column,
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """What ``work`` yields for the ``held`` rows of every key and the ``rows`` with it, in blocks.

    Both have the integer column ``key``. A task holds the few rows of ``held`` with one key
    at a time, while ``rows`` come by. A key with more than ``rows_per_task`` rows is dealt over
    several tasks by ``spread``, a hash of the rows, with a copy of the held rows in each.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("__n") / rows_per_task)).cast("int").alias("__salts")
    # One row per key, no more than ``held`` has.
    shares = F.broadcast(materialize(counts.select(key, salts), "shares"))
    kept = held.join(shares, key).select(
        F.col(key).alias("__split"),
        F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"),
        F.struct(*held.columns).alias("__document"),
        F.lit(None).cast(rows.schema).alias("__query"),
    )
    passing = rows.join(shares, key).select(
        F.col(key).alias("__split"),
        F.pmod(spread, F.col("__salts")).cast("int").alias("__salt"),
        F.lit(None).cast(held.schema).alias("__document"),
        F.struct(*rows.columns).alias("__query"),
    )
    dealt = (
        kept.unionByName(passing)
        .repartition("__split", "__salt")
        .sortWithinPartitions("__split", "__salt", F.col("__query").isNotNull())
    )
    return dealt.mapInArrow(_meeting(work), schema)


def _meeting(work: Worker) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker over sorted rows: those to hold first, then those that come by, per split."""

    def rows_of(batch: pa.RecordBatch, column: str) -> pa.Table:
        rows = batch.column(column).drop_null()
        return pa.Table.from_arrays(rows.flatten(), names=[f.name for f in rows.type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts, answer, passing = None, [], None, False
        for whole in batches:
            for batch in _stretches(whole):
                one = batch.column("__split")[0].as_py()
                held, asked = rows_of(batch, "__document"), rows_of(batch, "__query")
                # The next salt of the same split brings its rows again.
                if one != split or (held.num_rows and passing):
                    split, parts, answer, passing = one, [], None, False
                if held.num_rows:
                    parts.append(held)
                if asked.num_rows:
                    passing = True
                    if parts:
                        if answer is None:
                            answer = work(pa.concat_tables(parts))
                        yield from answer(asked)

    return run


def _stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a sorted batch that have one split, and either side only."""
    if not batch.num_rows:
        return
    split = batch.column("__split").to_numpy(zero_copy_only=False)
    asked = np.asarray(batch.column("__query").is_valid())
    edges = np.flatnonzero((np.diff(split) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.slice(start, stop - start)
