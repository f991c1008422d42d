"""Connected components of a link table by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node with a link.

    ``links`` has long columns ``a`` and ``b``. Every round hangs each node's larger
    neighbours on its smallest one, then its smaller ones; the table of links shrinks to
    one star per component in a number of rounds that grows with the logarithm of the
    longest path. Each round is written to the shared folder. Nothing but a count and a
    checksum reaches the driver. The minimum per node is combined before its shuffle and
    joined back, so a node with very many links is no group in one task's memory.
    """
    edges = materialize(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct(),
        "links",
    )
    before = _checksum(edges)
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = _checksum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node to the smallest of its neighbourhood."""
    both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
        edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return (
        both.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and itself, to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    joined = edges.join(least, "v")
    return (
        joined.select(F.col("u").alias("v"), F.col("m").alias("u"))
        .filter("v <> u")
        .unionByName(least.select("v", F.col("m").alias("u")))
        .distinct()
    )
