"""Joins of large tables with sides of unknown size and with hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.session import materialize

# A side of at most this many bytes is sent to every task.
BROADCAST_BYTES = 64 << 20
# A key with more rows than this is spread over SALTS tasks.
HOT_ROWS, SALTS = 1_000_000, 64


def join_side(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    row_bytes: int,
    how: str = "inner",
    most: int = BROADCAST_BYTES,
    hot: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row per key.

    ``side`` is stored and counted; up to ``most`` bytes, at ``row_bytes`` a row, it goes
    to all tasks and ``rows`` stay where they are. Beyond that both are shuffled, and keys
    with more than ``hot`` rows are dealt over ``salts`` tasks each, with a copy of their
    row in each. There are fewer than rows / ``hot`` such keys. A NULL key matches nothing.
    """
    keys = list(keys)
    side = materialize(side, "side")
    if side.count() * row_bytes <= most:
        return rows.join(F.broadcast(side), keys, how)
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot)
    often = materialize(often.select(*keys), "hot-keys")
    if not often.take(1):
        return rows.join(side, keys, how)
    marked = often if often.count() * 100 > most else F.broadcast(often)
    hashable = [f"`{f.name}`" for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    dealt = rows.join(marked, keys, "left_semi").withColumn(
        "__salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int")
    )
    copies = side.join(marked, keys, "left_semi").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    apart = dealt.join(copies, [*keys, "__salt"], how).drop("__salt")
    return rows.join(marked, keys, "left_anti").join(side, keys, how).unionByName(apart)
