"""New chunks into an index: update or insert, and comparison of two stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.schemas import LENGTH_LIMITS, NATURAL_KEY

UPDATED = ["content", "embedding", "indexed_at"]


def merge_index(
    current: DataFrame,
    batch: DataFrame,
    key: Sequence[str] = NATURAL_KEY,
    updated: Sequence[str] = UPDATED,
    nullable_key: Sequence[str] = ("name", "start_line"),
) -> DataFrame:
    """``current`` with the rows of ``batch`` inserted or, where the key is known, updated.

    An update changes the ``updated`` columns and leaves the others as stored. A NULL in
    the key matches nothing, so such rows are always inserted. Of several rows with one
    key in the batch the last by ``indexed_at`` counts.
    """
    key, columns = list(key), current.columns
    updated = [c for c in updated if c in columns]
    keyless = F.lit(False)
    for column in nullable_key:
        keyless = keyless | F.col(column).isNull()

    # One row per key, by an aggregate that merges copies before it shuffles.
    values = [c for c in columns if c not in key]
    by_time = [c for c in ("indexed_at", "content") if c in values]
    latest = F.max(F.struct(*by_time, *[c for c in values if c not in by_time]))
    incoming = batch.filter(~keyless).groupBy(*key).agg(latest.alias("__new"))
    stored = current.filter(~keyless).select(*key, F.struct(*values).alias("__old"))

    def merged(column: str) -> Column:
        known = F.col("__old").isNotNull()
        take_new = ~known | F.col("__new").isNotNull() if column in updated else ~known
        return (
            F.when(take_new, F.col(f"__new.{column}"))
            .otherwise(F.col(f"__old.{column}"))
            .alias(column)
        )

    joined = stored.join(incoming, key, "full_outer").select(*key, *[merged(c) for c in values])
    return (
        joined.select(*columns)
        .unionByName(current.filter(keyless))
        .unionByName(batch.filter(keyless).select(*columns))
    )


def replace_groups(
    current: DataFrame, batch: DataFrame, replaced: Sequence[str], column: str = "repo_name"
) -> DataFrame:
    """``current`` without the rows of the ``replaced`` groups, plus those of ``batch``."""
    kept = current.filter(~F.col(column).isin(list(replaced)))
    new = batch.filter(F.col(column).isin(list(replaced)))
    return kept.unionByName(new.select(*current.columns))


def reconcile(first: DataFrame, second: DataFrame, by: str = "repo_name") -> DataFrame:
    """Row counts of two stores per group, with their difference."""
    counts = [
        df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
        for df, name in ((first, "first_count"), (second, "second_count"))
    ]
    zero = F.lit(0).cast("bigint")
    return (
        counts[0]
        .join(counts[1], by, "full_outer")
        .select(
            by,
            F.coalesce("first_count", zero).alias("first_count"),
            F.coalesce("second_count", zero).alias("second_count"),
        )
        .withColumn("difference", F.col("first_count") - F.col("second_count"))
    )


def content_difference(
    first: DataFrame,
    second: DataFrame,
    key: Sequence[str] = NATURAL_KEY,
    group: Sequence[str] = ("model", "repo_name"),
    ignored: Sequence[str] = ("indexed_at",),
    buckets: int = 64,
) -> DataFrame:
    """Rows by which two stores differ: group, key, ``difference`` and how often each holds the row.

    ``difference`` is "only first", "only second" or "changed" (a key that both hold, with other
    contents). Digests that do not depend on order are compared first, per group and
    bucket of the file path; only the rows of buckets that differ are looked at one by one. Equal
    stores cost two aggregates over digests and no join of rows. Columns in ``ignored`` may differ.
    """
    group, key = list(group), list(key)
    others = sorted(set(first.columns) - {*group, *key, *ignored})

    def digested(store: DataFrame) -> DataFrame:
        name = F.sha2(F.to_json(F.struct(*[F.col(c) for c in key]), {"ignoreNullFields": "false"}), 256)
        body = F.sha2(F.to_json(F.struct(*[F.col(c) for c in others]), {"ignoreNullFields": "false"}), 256)
        return store.select(
            *group,
            *[c for c in key if c not in group],
            F.pmod(F.xxhash64("file_path"), F.lit(buckets)).alias("__bucket"),
            name.alias("__name"),
            body.alias("__body"),
        )

    sides = {"first": digested(first), "second": digested(second)}
    parts = [*group, "__bucket"]

    def summed(rows: DataFrame, side: str) -> DataFrame:
        # Sums of 32-bit pieces of a digest of key and content: order-free, and repeats count.
        row = F.sha2(F.concat("__name", "__body"), 256)
        pieces = [F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
        return rows.groupBy(*parts).agg(
            F.concat_ws(",", F.count(F.lit(1)), *[F.sum(p) for p in pieces]).alias(f"__{side}")
        )

    unequal = (
        summed(sides["first"], "first")
        .join(summed(sides["second"], "second"), parts, "full_outer")
        .filter(~F.col("__first").eqNullSafe(F.col("__second")))
        .select(*parts)
    )
    looked = [
        rows.join(unequal, parts, "left_semi").withColumn("__side", F.lit(side)) for side, rows in sides.items()
    ]
    columns = [*group, *[c for c in key if c not in group]]
    counted = (
        looked[0].unionByName(looked[1])
        .groupBy(*columns, "__name", "__body")
        .agg(
            F.count_if(F.col("__side") == "first").alias("first_count"),
            F.count_if(F.col("__side") == "second").alias("second_count"),
        )
        .filter("first_count <> second_count")
    )
    # A key has as many rows here as it has contents.
    by_key = counted.groupBy(*columns, "__name").agg(
        F.sum("first_count").alias("first_count"), F.sum("second_count").alias("second_count")
    )
    what = (
        F.when(F.col("second_count") == 0, "only first")
        .when(F.col("first_count") == 0, "only second")
        .otherwise("changed")
    )
    return by_key.select(*columns, what.alias("difference"), "first_count", "second_count")


def dimension_report(
    df: DataFrame, dims: int, by: Sequence[str] = (), vector: str = "embedding"
) -> DataFrame:
    """Rows per group, and how many have no vector or one of another dimension."""
    size = F.size(vector)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.col(vector).isNull()).alias("missing"),
        F.count_if(size != dims).alias("wrong_dims"),
    )


def checked(df: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """``df`` unchanged, failing on a row the store would refuse.

    Refused are a missing vector or one of another dimension, a missing repo_name,
    file_path, chunk_type or content, and a text over its length limit.
    """
    rules = [(F.size(vector) == dims, f"the vector has not {dims} components")]
    for column in ["repo_name", "file_path", "chunk_type", "content"]:
        if column in df.columns:
            rules.append((F.col(column).isNotNull(), f"{column} is NULL"))
    for column, limit in LENGTH_LIMITS.items():
        if column in df.columns:
            fits = F.coalesce(F.length(column) <= limit, F.lit(True))
            rules.append((fits, f"{column} exceeds {limit} characters"))
    broken = F.lit(None).cast("string")
    for holds, message in reversed(rules):
        broken = F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)).otherwise(broken)
    # The vector itself carries the check, so that the optimizer cannot drop it.
    guarded = F.when(broken.isNull(), F.col(vector)).otherwise(
        F.raise_error(broken).cast(df.schema[vector].dataType)
    )
    return df.withColumn(vector, guarded)
