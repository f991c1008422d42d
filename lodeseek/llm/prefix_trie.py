"""A prefix trie over conversations, from whole sequences collapsed into weighted ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.crc import crc32_sql
from lodeseek.llm.joins import counted_side
from lodeseek.operators.positions import running
from lodeseek.session import load_table, materialize

# Members of an end list that are written into one piece of text.
LIST_PIECE = 512
# Parents with more children than this are joined apart: there are few of them.
HUB_CHILDREN = 1000
# Fixed values, by the contract of the query: siblings that share turns, and turns shared.
SHARING, TURNS = 5, 9


def numbered_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(``conv``, ``place``, ``h1``, ``h2``, ``bytes``): the turns of all conversations in order.

    ``place`` counts from 1 by turn (NULL first); equal turns are ordered by digest. NULL role
    or text is empty. ``h1`` and ``h2`` are a digest of both, ``bytes`` the UTF-8 length of the
    text. Rows without a conversation belong to none and are left out. Texts are read here
    and not carried on.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.concat(F.lit("1"), digest)).alias("h1"),
        F.xxhash64(F.concat(F.lit("2"), digest)).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    one = F.lit(1).cast("long")
    placed = running(
        materialize(narrow, "turns"), ["turn", "h1", "h2", "bytes"], ["conv"], {"place": ("sum", one)}
    )
    return materialize(placed.drop("turn"), "placed-turns")


def rebuilt_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequences (``conv``, ``depth``, ``h1``, ``h2``, ``bytes``) and all ids (``conv``).

    Conversation c has the first h turns of c - c % 5 (all if there are fewer, none if
    there is no such conversation), h being crc32 of c as text modulo 9, then its own after
    its first h. A head has eight turns at most, so it travels as one array.
    """
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(TURNS))
    turn = F.struct("place", "h1", "h2", "bytes")
    heads = (
        turns.filter((F.col("conv") % SHARING == 0) & (F.col("place") < TURNS))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(turn)).alias("head"))
    )
    ids = turns.select("conv").distinct().select(
        "conv", shared.cast("int").alias("h"), (F.col("conv") - F.col("conv") % SHARING).alias("base")
    )
    convs = materialize(
        ids.join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h")))
        .select("conv", "h", "head"),
        "conversation-heads",
    )
    copied = convs.select("conv", F.inline("head")).withColumnRenamed("place", "depth")
    # Own turns follow the head; only where that is shorter than h do they move up.
    short = materialize(
        convs.filter(F.size("head") < F.col("h")).select("conv", F.size("head").alias("had")), "short-heads"
    )
    own = turns.withColumn("h", shared).filter(F.col("place") > F.col("h")).join(
        counted_side(short), "conv", "left"
    )
    own = own.select(
        "conv",
        (F.col("place") - F.col("h") + F.coalesce("had", "h")).alias("depth"),
        "h1",
        "h2",
        "bytes",
    )
    return copied.unionByName(own), convs.select("conv")


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences, from the empty one.

    ``sequences`` has a row per conversation and ``depth`` (1, 2, ...) with the digest ``h1``,
    ``h2`` of the turn and its ``bytes``; ``convs`` names all conversations, also those without
    turns. Result: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's,
    NULL at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the node
    and all below it, (members - 1) times the bytes of its last turn), ``ends_sha256`` (of the
    ids of the conversations that end here, ascending, joined by commas). Without any
    conversation there is no row.

    Sequences that are equal as a whole are collapsed into one with a weight and an end
    list; those that are a proper prefix of another leave by an anti-join, and what remains
    are the leaves. Nodes are aggregates of the weighted sequences' prefixes, combined before
    their shuffle, so that a first turn that all share is no group in one task. A prefix
    is named by 128 bits, the exclusive or of hashes of (depth, turn); its parent's name is
    that without the last turn's, so no parent has to be looked up. Totals along a sequence run
    over stretches of it, however long it is.

    For ``saved_tokens`` every node belongs to the smallest leaf below it. A leaf owns the end
    of its path, so what it owns below a node is all of it, unless it owns the node itself:
    then it is the part from there on. The sum over the leaves below is one aggregate.
    """
    piece = [F.xxhash64(F.lit(n), "depth", "h1", "h2") for n in (1, 2)]
    salted = sequences.select("conv", "depth", "bytes", piece[0].alias("p1"), piece[1].alias("p2"))
    named = running(
        materialize(salted, "sequences"), ["depth"], ["conv"], {"a": ("xor", "p1"), "b": ("xor", "p2")}
    ).select(
        "conv",
        F.col("depth").cast("long").alias("depth"),
        "bytes",
        "a",
        "b",
        F.col("a").bitwiseXOR(F.col("p1")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("p2")).alias("pb"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    empty = convs.select(
        "conv", *[zero.alias(c) for c in ("depth", "bytes", "a", "b")], none.alias("pa"), none.alias("pb")
    )
    prefixes = materialize(named.unionByName(empty), "prefixes")
    node = ["a", "b"]

    # Whole sequences with weight, smallest member and end list.
    ends = materialize(
        prefixes.groupBy("conv").agg(F.max(F.struct("depth", "a", "b")).alias("end")).select("conv", "end.a", "end.b"),
        "ends",
    )
    whole = ends.groupBy(*node).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv"))
    children = materialize(
        prefixes.filter("depth > 0").select("pa", "pb", *node).distinct()
        .groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children")),
        "children",
    )
    whole = materialize(whole, "whole-sequences")
    leaves = whole.join(children, node, "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    inner = whole.join(children, node, "left_semi").withColumn("leaf", zero)
    weighted = materialize(leaves.unionByName(inner).select("conv", "weight", "leaf"), "weighted-sequences")

    # Weighted prefixes, one row per node.
    counted = prefixes.join(weighted, "conv").groupBy(*node).agg(
        F.max("depth").alias("depth"),
        F.max("bytes").alias("bytes"),
        F.max("pa").alias("pa"),
        F.max("pb").alias("pb"),
        F.sum("weight").alias("n_convs"),
        F.min("conv").alias("conv_id"),
        F.sum("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf") == 1, F.col("conv"))).alias("owner"),
    )
    nodes = materialize(
        counted.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"), "trie-nodes"
    )
    owned = materialize(
        nodes.groupBy(F.col("owner").alias("conv"))
        .agg(F.sum("saved").alias("all_saved"), F.min("depth").alias("from_depth"))
        .filter("all_saved > 0 AND from_depth > 0"),
        "owned-paths",
    )
    deeper = (
        prefixes.join(counted_side(owned), "conv")
        .filter(F.col("depth") < F.col("from_depth"))
        .groupBy(*node)
        .agg(F.sum("all_saved").alias("others"))
    )
    below = running(nodes, [F.col("depth").desc()], ["owner"], {"own": ("sum", "saved")})
    full = below.join(deeper, node, "left").join(children, node, "left").join(_end_lists(ends), node, "left")
    full = materialize(full, "trie-rows")
    parents = full.select(
        F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    hubs = counted_side(
        materialize(parents.filter(F.col("n_children") > HUB_CHILDREN).drop("n_children"), "trie-hubs")
    )
    rest = parents.filter(F.col("n_children") <= HUB_CHILDREN).drop("n_children")
    of = ["pa", "pb"]
    placed = full.filter("depth = 0").withColumn("parent_conv_id", none)
    placed = placed.unionByName(full.join(hubs, of).select(*placed.columns))
    placed = placed.unionByName(full.join(rest, of).select(*placed.columns))
    return placed.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        (F.col("own") + F.coalesce("others", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _end_lists(ends: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``ends_sha256``) of the ascending ids of the conversations that end there.

    A long list is written in pieces, which are hashed one after another: a task
    holds an Arrow batch of them, never the list.
    """
    node = ["a", "b"]
    placed = running(ends, ["conv"], node, {"place": ("sum", F.lit(1).cast("long"))})
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = placed.groupBy(*node, F.expr(f"(place - 1) div {LIST_PIECE}").alias("piece")).agg(
        F.array_join(ids, ",").alias("ids")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for a, b, ids_ in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) == current:
                    state.update(b"," + ids_.encode())
                    continue
                if current is not None:
                    done.append((*current, state.hexdigest()))
                current, state = (a, b), hashlib.sha256(ids_.encode())
            yield from _lists(done)
        if current is not None:
            yield from _lists([(*current, state.hexdigest())])

    in_order = pieces.repartition(*node).sortWithinPartitions(*node, "piece")
    return in_order.mapInArrow(work, "a long, b long, ends_sha256 string")


def _lists(rows: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
    if rows:
        a, b, digests = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digests)],
            names=["a", "b", "ends_sha256"],
        )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    turns = numbered_turns(load_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt_conversations(turns))


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT c, c - c % {SHARING} AS base, {crc32_sql('c::varchar')} % {TURNS} AS h FROM (SELECT DISTINCT c FROM t)
), parts AS (
  SELECT i.c, 0 AS own, t.pos, role, text FROM ids i JOIN t ON t.c = i.base AND t.pos <= i.h
  UNION ALL
  SELECT i.c, 1, t.pos, role, text FROM ids i JOIN t ON t.c = i.c AND t.pos > i.h
), seq AS (
  SELECT c, octet_length(encode(text)) AS bytes,
         row_number() OVER (PARTITION BY c ORDER BY own, pos) AS depth,
         list(sha256(octet_length(encode(role)) || ':' || role || text)) OVER (PARTITION BY c ORDER BY own, pos) AS path
  FROM parts
), pre AS (
  SELECT c, depth, bytes, array_to_string(path, '') AS node, array_to_string(path[:depth - 1], '') AS parent FROM seq
  UNION ALL
  SELECT c, 0, 0, '', NULL FROM ids
), lens AS (SELECT c, max(depth) AS len FROM pre GROUP BY c),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256
  FROM pre JOIN lens USING (c) GROUP BY node
), kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
below AS (
  SELECT r.node, sum((u.n_convs - 1) * u.bytes) AS saved, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes u JOIN pre r ON r.c = u.conv_id AND r.depth <= u.depth LEFT JOIN kids k ON k.node = u.node
  GROUP BY r.node
)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON p.node = v.parent
"""
