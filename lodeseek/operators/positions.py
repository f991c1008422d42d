"""Row numbers and what follows from them, without a group in a single task.

A window with `row_number()` sorts each group in one task, and an unpartitioned one the
whole table. Here the table is range-partitioned on group and order together, so a group
of any size, and rows with equal values, spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodeseek.session import materialize

_ROW, _PART = "__row", "__part"


def number_rows(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """Add 1, 2, ... in ``order`` within each group of ``by`` (or over the whole table).

    ``order`` should end in a unique key; rows which tie on all of it are numbered in
    any order.

    One range shuffle and one write; the numbers then come from the sorted row ids minus
    where each group's stretch of a partition starts. The range shuffle reads ``df``
    twice, once for a sample, so costly work should be materialized before.
    """
    stored = _sorted_and_stored(df, [*by, *order])
    # At most (groups + partitions) rows, and per group at most one per partition.
    stretches = stored.groupBy(*by, _PART).agg(
        F.min(_ROW).alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    shift = F.coalesce(F.sum("__rows").over(_before(by)), F.lit(0)) - F.col("__first") + 1
    stretches = stretches.select(*by, _PART, shift.alias("__shift"))
    return _with_stretch(stored, stretches, by).select(
        *df.columns, (F.col(_ROW) + F.col("__shift")).alias(name)
    )


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str],
    totals: dict[str, tuple[str, str | Column]],
) -> DataFrame:
    """Add running totals, this row included, in ``order`` within each group of ``by``.

    ``totals`` names each new column with its kind, "sum" or "xor", and what is totalled.
    ``order`` should end in a unique key, as in `number_rows`. A group may be
    larger than a task: totals run within the stretches of a range partition, and what came
    before is added where a group goes on in the next partition. There is one such stretch
    per partition at most, so these are sent to all tasks.
    """
    kinds = {"sum": F.sum, "xor": F.bit_xor}
    given = df.withColumns(
        {f"__total_{n}": F.col(of) if isinstance(of, str) else of for n, (_, of) in totals.items()}
    )
    stored = _sorted_and_stored(given, [*by, *order])
    within = Window.partitionBy(*by, _PART).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    local = stored.withColumns(
        {f"__local_{n}": kinds[kind](f"__total_{n}").over(within) for n, (kind, _) in totals.items()}
    )
    stretches = stored.groupBy(*by, _PART).agg(
        F.lit(1).alias("__one"),
        *[kinds[kind](f"__total_{n}").alias(f"__total_{n}") for n, (kind, _) in totals.items()],
    )
    carried = stretches.select(
        *by,
        _PART,
        F.sum("__one").over(_before(by)).alias("__one"),
        *[kinds[kind](f"__total_{n}").over(_before(by)).alias(f"__carried_{n}") for n, (kind, _) in totals.items()],
    ).filter("__one IS NOT NULL").drop("__one")
    joined = _with_stretch(local, F.broadcast(carried), by, "left")

    def total(name: str, kind: str) -> Column:
        carry = F.coalesce(F.col(f"__carried_{name}"), F.lit(0))
        here = F.col(f"__local_{name}")
        return (here + carry if kind == "sum" else here.bitwiseXOR(carry)).alias(name)

    return joined.select(*df.columns, *[total(n, kind) for n, (kind, _) in totals.items()])


def exact_percentiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str]
) -> DataFrame:
    """Percentiles by linear interpolation, one row per group, one column per entry.

    Equal values are counted before the shuffle. The distinct ones are sorted across
    tasks, and only the stretches of them which hold a wanted rank are looked into: no
    group's values meet in one task. A group without values has no row.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("__value"))
        .agg(F.count(F.lit(1)).alias("__count"))
    )
    counts = materialize(counts, "counts")
    stored = _sorted_and_stored(counts, [*by, "__value"])
    stretches = (
        stored.groupBy(*by, _PART)
        .agg(F.sum("__count").alias("__rows"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(_before(by)), F.lit(0)))
        .withColumn("__size", F.sum("__rows").over(Window.partitionBy(*by)))
    )

    def ranks(p: float) -> tuple[Column, Column]:
        """The lower of the two ranks (from 1) around a percentile, the share of the upper."""
        at = F.lit(float(p)) * (F.col("__size") - 1)
        return F.floor(at) + 1, at - F.floor(at)

    def holds(rank: Column, first: Column, rows: Column) -> Column:
        return (rank > first) & (rank <= first + rows)

    lower = [ranks(p)[0] for p in probabilities.values()]
    hit = reduce(
        or_,
        [holds(r, F.col("__before"), F.col("__rows")) for low in lower for r in (low, low + 1)],
    )
    # A stretch is a part of one range partition, however large its group is.
    within = Window.partitionBy(*by, _PART).orderBy(_ROW)
    first = F.col("__before") + F.sum("__count").over(within) - F.col("__count")
    values = _with_stretch(stored, stretches.filter(hit), by).withColumn("__at", first)
    parts = []
    for label, p in probabilities.items():
        low, share = ranks(p)
        weight = F.when(holds(low, F.col("__at"), F.col("__count")), 1 - share).otherwise(0.0)
        weight += F.when(holds(low + 1, F.col("__at"), F.col("__count")), share).otherwise(0.0)
        parts.append(F.sum(weight * F.col("__value")).alias(label))
    return values.groupBy(*by).agg(*parts)


def _sorted_and_stored(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned in order, with ascending row ids and partition numbers."""
    sorted_rows = df.orderBy(*order).withColumn(_ROW, F.monotonically_increasing_id())
    return materialize(sorted_rows, "sorted").withColumn(
        _PART, F.shiftrightunsigned(F.col(_ROW), 33)
    )


def _before(by: Sequence[str]) -> WindowSpec:
    """The earlier stretches of a group."""
    return Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def _with_stretch(
    stored: DataFrame, stretches: DataFrame, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Stored rows with the columns of the stretch they belong to; groups may be NULL."""
    keys = [*by, _PART]
    renamed = stretches.select(
        *[F.col(c).alias(f"__of_{c}") for c in keys],
        *[c for c in stretches.columns if c not in keys],
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys])
    return stored.join(renamed, same, how).drop(*[f"__of_{c}" for c in keys])


def batch_groups(
    df: DataFrame, order: Sequence[str | Column], size: int, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``batch``: consecutive rows of each group in batches of ``size``, from 0."""
    numbered = number_rows(df, order, by, "__position")
    return numbered.withColumn(
        "batch", F.floor((F.col("__position") - 1) / size).cast("bigint")
    ).drop("__position")
