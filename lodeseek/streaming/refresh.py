"""Incremental index refresh: new and changed files update the index.

A listing of the tree is compared with the files seen before, and what is new or changed
is appended to a table of changes. A stream over that table reads the files, cuts and
embeds them and merges them into the index.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.plans.indexing import rows_for_index
from lodeseek.registry import DEFAULT_MODEL, ModelSpec
from lodeseek.session import materialize
from lodeseek.sources.index_store import IndexStore
from lodeseek.sources.repositories import (
    exclude_repos,
    indexable,
    list_tree,
    read_files,
    source_texts,
    tracked_only,
)

CHANGES = "repo_name string, rel_path string, size bigint, modified_ns bigint, language string"
FAILED = f"{CHANGES}, error string, batch_id bigint"


VERSION = ["repo_name", "rel_path", "size", "modified_ns"]

# Batches of one run, about. Each has a price of its own and writes the groups it touches anew.
MOST_BATCHES = 8


def _read_if_there(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def note_changes(
    listing: DataFrame, changes: str, failed: str, files_per_batch: int, buckets: int = 1
) -> None:
    """Append files that are new, or differ in size or time, to the table of changes.

    So are files that could not be read as often as they were noted. Changes lie in the
    order of the index's partitions, so that a batch touches few of them. A batch has about
    ``files_per_batch`` files, or more if that made more than MOST_BATCHES: with batches of
    one size their number would grow with the changes, and so would the index that each of
    them writes anew, and the time with the square.
    """
    spark = listing.sparkSession
    noted = _read_if_there(spark, CHANGES, changes).groupBy(*VERSION).agg(
        F.count(F.lit(1)).alias("noted")
    )
    # A batch that is replayed has failed once.
    broken = _read_if_there(spark, FAILED, failed).groupBy(*VERSION).agg(
        F.count_distinct("batch_id").alias("failed")
    )
    done = noted.join(broken, VERSION, "left").filter(
        F.col("noted") > F.coalesce("failed", F.lit(0))
    )
    columns = [field.split()[0] for field in CHANGES.split(", ")]
    changed = materialize(listing.join(done, VERSION, "left_anti").select(*columns), "changed")
    batches = max(1, min(MOST_BATCHES, -(-changed.count() // files_per_batch)))
    order = ["repo_name", F.pmod(F.xxhash64("rel_path"), F.lit(buckets)), "rel_path"]
    # A task writes one file, and a file is a batch.
    (
        changed.repartitionByRange(batches, *order)
        .sortWithinPartitions(*order)
        .write.mode("append")
        .parquet(changes)
    )


def refresh_index(
    spark: SparkSession,
    root: str,
    store: IndexStore,
    state: str,
    repo_name: str | None = None,
    model: str | ModelSpec = DEFAULT_MODEL,
    manifest: DataFrame | None = None,
    exclude: Iterable[str] = (),
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Index what is new or changed below ``root`` since the last run, then stop.

    ``state`` is a directory for the table of changes and the progress of the stream.
    Every micro-batch is an upsert by natural key, so a batch that is replayed after a
    failure changes nothing. A file that cannot be read is kept in a table of its own,
    with the reason, and tried again at the next run. As with an upsert, chunks that are gone from a file stay
    until their repository is replaced.
    """
    listing = indexable(list_tree(spark, root, repo_name).filter("error IS NULL"))
    listing = exclude_repos(tracked_only(listing, manifest), exclude)
    changes, failed = state_tables(state)
    note_changes(listing, changes, failed, files_per_batch, store.buckets)
    return merge_changes(spark, root, store, state, repo_name, model)


def state_tables(state: str) -> tuple[str, str]:
    """The folders of the changes and of the files that could not be read."""
    return f"{state.rstrip('/')}/changes", f"{state.rstrip('/')}/failed"


def failed_files(spark: SparkSession, state: str) -> DataFrame:
    """The files that could not be read, with the reason, once per batch that tried."""
    return _read_if_there(spark, FAILED, state_tables(state)[1])


def merge_changes(
    spark: SparkSession,
    root: str,
    store: IndexStore,
    state: str,
    repo_name: str | None = None,
    model: str | ModelSpec = DEFAULT_MODEL,
) -> StreamingQuery:
    """The second half of `refresh_index`: merge the noted changes not yet merged, then stop."""
    changes, failed = state_tables(state)

    def merge(batch: DataFrame, batch_id: int) -> None:
        files = materialize(read_files(batch, root, repo_name is not None), "refresh")
        store.upsert(rows_for_index(source_texts(files), model))
        (
            files.filter("error IS NOT NULL")
            .drop("content")
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("append")
            .parquet(failed)
        )

    return (
        spark.readStream.schema(CHANGES)
        .option("maxFilesPerTrigger", 1)
        .parquet(changes)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{state.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .start()
    )
