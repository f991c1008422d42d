"""Merkle manifest of a dataset: a hash tree per group of rows, and one over the groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.crc import crc32_sql
from lodeseek.llm.joins import counted_side
from lodeseek.operators.positions import running
from lodeseek.session import load_table, materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The tree over the groups has this name; names of groups begin with "-" (NULL) or "=".
_TOP = ""


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(
        F.concat(
            *[
                F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                for t in texts
            ]
        ),
        256,
    )


def merkle_manifest(
    leaves: DataFrame,
    group_col: str,
    order: Sequence[str],
    leaf_col: str = "leaf",
    fanout: int = FANOUT,
) -> DataFrame:
    """All columns of ``leaves`` with ``subroot``, ``root`` and ``path``.

    Per value of ``group_col`` (NULL is a group like others) the digests in ``leaf_col``,
    sorted by ``order`` (NULLs first) and then by digest, are level by level replaced by the
    hash of ``fanout`` consecutive ones; the last run may be shorter. The one that remains is
    ``subroot``. Subroots, sorted by group (NULL first, then bytewise), give ``root`` in
    the same way. ``path`` holds, level by level, the digests ``before`` and ``after`` a row's
    node in its run, as bytes one after another; `folded` computes the root from it.

    Every level is a join of its nodes with themselves: a node asks for the numbers of its
    siblings (exclusive or for two, else shifts of its slot), each node is the answer to
    fewer than ``fanout`` questions, and the node of slot zero, which has the whole run,
    yields the parent. Keys are (group, number), so neither a large group nor equal
    digests gather anywhere. Paths go down from the root: a parent gives its own to
    ``fanout`` children at most. The driver sees one count, the largest group's.

    Rows that are repeated with ``order`` and digest are interchangeable leaves of their
    own. An empty table gives no rows.
    """
    columns = leaves.columns
    name = F.when(F.col(group_col).isNull(), F.lit("-")).otherwise(
        F.concat(F.lit("="), F.col(group_col).cast("string"))
    )
    named = materialize(
        leaves.select(
            name.alias("__tree"),
            *[F.col(c).alias(f"__order{n}") for n, c in enumerate(order)],
            F.unhex(leaf_col).alias("__digest"),
            F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__carried"),
        ),
        "merkle-leaves",
    )
    numbered = _numbered(named, [f"__order{n}" for n in range(len(order))])
    trees = _levels(numbered, fanout, "merkle")
    subroots = trees.roots.select(
        F.lit(_TOP).alias("__tree"), F.col("__tree").alias("__group"), F.col("__tree").alias("__carried"), "__digest"
    )
    tops = _numbered(subroots, ["__group"])
    top = _levels(tops, fanout, "merkle-top")
    no_path = F.array().cast("array<struct<before:binary,after:binary>>")
    # The tree over the groups: its only root has no siblings.
    crown = top.roots.select("__tree", "__level", F.col("__digest").alias("__root"), no_path.alias("__path"))
    above = _descended(top, crown, ["__root"]).select(
        F.col("__carried").alias("__tree"), F.col("__digest").alias("__subroot"), "__root", "__path"
    )
    above = trees.roots.select("__tree", "__level").join(counted_side(materialize(above, "merkle-roots")), "__tree")
    done = _descended(trees, above, ["__subroot", "__root"])
    return done.select(
        *[F.col(f"__carried.`{c}`").alias(c) for c in columns],
        F.lower(F.hex("__subroot")).alias("subroot"),
        F.lower(F.hex("__root")).alias("root"),
        F.col("__path").alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, as lowercase hex."""
    return F.aggregate(
        path,
        leaf,
        lambda digest, level: F.sha2(
            F.concat(F.lower(F.hex(level["before"])), digest, F.lower(F.hex(level["after"]))), 256
        ),
    )


def proof_hash(path: Column) -> Column:
    """SHA-256 of all sibling digests on a path, from the leaf up, left to right."""
    return F.sha2(
        F.array_join(
            F.transform(path, lambda x: F.lower(F.concat(F.hex(x["before"]), F.hex(x["after"])))), ""
        ),
        256,
    )


class _Levels:
    """Stored levels of all trees: nodes with siblings per level, the leaves that are alone,
    and the ``roots`` with the level at which each tree came to one."""

    def __init__(self, levels: list[DataFrame], alone: DataFrame, roots: DataFrame, fanout: int):
        self.levels, self.alone, self.roots, self.fanout = levels, alone, roots, fanout


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Nodes with ``__at``, their number in their tree from 0, and ``__size``, its leaves."""
    placed = running(
        nodes, [*order, "__digest"], ["__tree"], {"__place": ("sum", F.lit(1).cast("long"))}
    )
    placed = materialize(placed.withColumn("__at", F.col("__place") - 1).drop("__place", *order), "merkle-numbers")
    sizes = materialize(placed.groupBy("__tree").agg(F.count(F.lit(1)).alias("__size")), "merkle-sizes")
    return placed.join(counted_side(sizes), "__tree")


def _sibling_numbers(at: Column, size: Column, fanout: int) -> Column:
    """Numbers of the other nodes in a node's run."""
    if fanout == 2:
        numbers = F.array(at.bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = at % fanout
        numbers = F.array(*[at - slot + (slot + shift) % fanout for shift in range(1, fanout)])
    return F.filter(numbers, lambda n: n < size)


def _levels(nodes: DataFrame, fanout: int, label: str) -> _Levels:
    nodes = materialize(nodes, f"{label}-nodes")
    most = nodes.agg(F.max("__size")).first()[0] or 0
    alone = nodes.filter("__size = 1")
    levels, roots, level = [], [], 0
    current = nodes
    while True:
        roots.append(
            current.filter("__size = 1").select("__tree", F.lit(level).alias("__level"), "__digest")
        )
        if most <= 1:
            break
        stored = materialize(_with_siblings(current.filter("__size > 1"), fanout), f"{label}-{level}")
        levels.append(stored)
        # The node of slot zero has the whole run and yields the parent.
        whole = F.lower(F.concat(F.hex("__digest"), F.hex("__after")))
        current = stored.filter(F.col("__at") % fanout == 0).select(
            "__tree",
            F.expr(f"__at div {fanout}").alias("__at"),
            F.expr(f"(__size + {fanout - 1}) div {fanout}").alias("__size"),
            F.unhex(F.sha2(whole, 256)).alias("__digest"),
        )
        most, level = -(-most // fanout), level + 1
    return _Levels(levels, alone, reduce(DataFrame.unionByName, roots), fanout)


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with the digests ``__before`` and ``__after`` them in their run."""
    asked = nodes.select(
        "__tree", "__at", F.explode(_sibling_numbers(F.col("__at"), F.col("__size"), fanout)).alias("__sibling")
    )
    answers = nodes.select(
        "__tree", F.col("__at").alias("__sibling"), F.col("__digest").alias("__other")
    )
    found = asked.join(answers, ["__tree", "__sibling"]).groupBy("__tree", "__at").agg(
        # Fewer than ``fanout`` of them.
        F.array_sort(F.collect_list(F.struct("__sibling", "__other"))).alias("__others")
    )

    def joined(wanted: Column) -> Column:
        return F.aggregate(wanted, F.lit(b""), lambda all_, x: F.concat(all_, x["__other"]))

    others = F.coalesce("__others", F.array().cast("array<struct<__sibling:bigint,__other:binary>>"))
    # A run of one, at the end, has no siblings.
    return (
        nodes.join(found, ["__tree", "__at"], "left")
        .withColumn("__before", joined(F.filter(others, lambda x: x["__sibling"] < F.col("__at"))))
        .withColumn("__after", joined(F.filter(others, lambda x: x["__sibling"] > F.col("__at"))))
        .drop("__others")
    )


def _descended(trees: _Levels, crowns: DataFrame, given: Sequence[str]) -> DataFrame:
    """The leaves of all trees with ``__path`` and the ``given`` columns of their ``crowns``.

    ``crowns`` has a row per tree with the ``__level`` of its root, and the path from there up.
    """
    given = list(given)
    path = None
    for level in range(len(trees.levels), 0, -1):
        here = crowns.filter(F.col("__level") == level).select(
            "__tree", F.lit(0).cast("long").alias("__parent"), *given, "__path"
        )
        if path is not None:
            here = here.unionByName(path.select("__tree", F.col("__at").alias("__parent"), *given, "__path"))
        nodes = trees.levels[level - 1].withColumn("__parent", F.expr(f"__at div {trees.fanout}"))
        own = F.array(F.struct(F.col("__before").alias("before"), F.col("__after").alias("after")))
        path = (
            nodes.join(here, ["__tree", "__parent"])
            .withColumn("__path", F.concat(own, F.col("__path")))
            .drop("__before", "__after", "__parent")
        )
    single = trees.alone.join(crowns.filter("__level = 0").drop("__level"), "__tree")
    columns = ["__tree", "__carried", "__digest", *given, "__path"]
    return single.select(*columns) if path is None else path.select(*columns).unionByName(single.select(*columns))


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, ``leaf``, ``tampered``) of documents.

    ``tampered`` is the hash of the row with A-Z of the text in lower case, for ids whose
    unsigned crc32 as text is divisible by three; else, and for a NULL id, it is ``leaf``.
    """
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_hash(*fields)
    changed = F.when(hit, leaf_hash(*fields[:-1], lowered)).otherwise(F.lit(None))
    return docs.select("doc_id", "lang", leaf.alias("leaf"), changed.alias("changed")).select(
        "doc_id", "lang", "leaf", F.coalesce("changed", "leaf").alias("tampered")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and whether a tampered copy is noticed."""
    leaves = tampered_leaves(load_table(spark, sf_dir, "documents"))
    manifest = merkle_manifest(leaves, "lang", ["doc_id"])
    proved = manifest.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_hash(F.col("path")).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("path")).alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(first: str, tree: str, levels: int, name: str) -> str:
    """CTEs of the levels above ``first`` (tree, pos, digest), without a self-join."""
    steps = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY {tree}) AS n FROM {first})"]
    for k in range(levels):
        steps.append(
            f"{name}{k + 1} AS (SELECT {tree}, pos // {FANOUT} AS pos,"
            f" CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest,"
            f" (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k} GROUP BY {tree}, pos // {FANOUT})"
        )
    return ",\n".join(steps)


def _path_sql(levels: int, name: str, tree: str, row: str) -> tuple[str, str]:
    """Per row, the digests before and after it at each level, as select items and joins."""
    items, joins = [], []
    for k in range(levels):
        # A run's digests by slot; a tree that has come to one node has no more levels.
        joins.append(
            f"JOIN (SELECT {tree}, pos // {FANOUT} AS run, any_value(n) AS n,"
            f" list(digest ORDER BY pos) AS digests FROM {name}{k} GROUP BY {tree}, pos // {FANOUT}) {name}r{k}"
            f" ON {name}r{k}.{tree} IS NOT DISTINCT FROM {row}.{tree}"
            f" AND {name}r{k}.run = {row}.pos // {FANOUT ** (k + 1)}"
        )
        items.append(
            f"CASE WHEN {name}r{k}.n > 1 THEN {{'slot': ({row}.pos // {FANOUT**k}) % {FANOUT} + 1,"
            f" 'digests': {name}r{k}.digests}} END"
        )
    return ", ".join(items), "\n".join(joins)


def _merkle_sql(group_levels: int = 9, top_levels: int = 4) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    crc = crc32_sql('doc_id::varchar')
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    items, joins = _path_sql(group_levels, "g", "lang", "l")
    top_items, top_joins = _path_sql(top_levels, "t", "top", "s")
    return f"""
WITH leaves AS (
  SELECT doc_id, lang, {leaf('text')} AS digest,
         CASE WHEN ({crc}) % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS pos
  FROM documents
),
{_levels_sql('leaves', 'lang', group_levels, 'g')},
subroots AS (
  SELECT lang, digest, 1 AS top, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM g{group_levels}
),
{_levels_sql('(SELECT top, pos, digest FROM subroots)', 'top', top_levels, 't')},
paths AS (
  SELECT l.doc_id, l.digest AS leaf, l.tampered, s.digest AS subroot, (SELECT digest FROM t{top_levels}) AS root,
         list_filter([{items}, {top_items}], lambda x: x IS NOT NULL) AS path
  FROM leaves l
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  {joins}
  {top_joins}
), proved AS (
  SELECT doc_id, leaf, subroot, root,
         sha256(array_to_string(list_transform(path, lambda x: array_to_string(
           list_concat(x.digests[:x.slot - 1], x.digests[x.slot + 1:]), '')), '')) AS proof_sha256,
         list_reduce(list_concat([{{'slot': 0, 'digests': [tampered]}}], path), lambda a, x:
           {{'slot': 0, 'digests': [sha256(array_to_string(list_concat(
             x.digests[:x.slot - 1], a.digests, x.digests[x.slot + 1:]), ''))]}}).digests[1] AS folded_root
  FROM paths
)
SELECT *, folded_root = root AS verified FROM proved
"""


OP11_SQL = _merkle_sql()
