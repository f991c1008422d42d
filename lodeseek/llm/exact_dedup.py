"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.joins import counted_side
from lodeseek.session import load_table, materialize

PREFIX_CHARS = 64

_DELETED = " \t\n\x0b\x0c\r"


def normalized(text: Column) -> Column:
    """A text without its white space; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _DELETED, "")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **carry: Column
) -> DataFrame:
    """One row per row of ``df``: which row of its group of equal texts stays.

    Texts are equal when they are identical without white space; a NULL text is an empty
    one, and all empty texts are one group. The row with the most code points in its
    original text stays, of those the one with the smallest id (NULL last), then the
    smallest text. Of rows that are repeated with id and text exactly one stays.

    Columns: the id, ``text_md5`` (of the original text), ``n_chars``, ``group_hash``
    (SHA-256 of the normalised text, NULL for rows that refinement showed to be alone),
    ``keep_id``, ``group_size``, ``kept``, and ``carry``, computed from ``df``.
    Other columns of ``df`` are not looked at, so their names cannot clash.

    Three rounds, each over what the round before left: lengths that occur once, then
    prefixes that occur once, are out. Only the rest has its whole content hashed. All
    counts are combined before the shuffle, and no text is shuffled where the surviving
    groups are few enough to send.
    """
    rows = df.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        normalized(F.col(text_col)).alias("__norm"),
        *[column.alias(name) for name, column in carry.items()],
    ).select(
        "__id",
        "__norm",
        F.md5(F.coalesce("__text", F.lit(""))).alias("text_md5"),
        F.char_length(F.coalesce("__text", F.lit(""))).cast("long").alias("n_chars"),
        F.length("__norm").alias("__len"),
        F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("__prefix"),
        *carry,
    )
    keys = ["__len", "__prefix"]
    narrow = materialize(rows.drop("__norm"), "exact-keys")
    lengths = _repeated(narrow, ["__len"])
    survivors = narrow.join(lengths, ["__len"], "left_semi")
    groups = counted_side(materialize(_repeated(survivors, keys), "exact-groups"))
    hashed = rows.join(groups, keys, "left_semi").select(
        "__id", "text_md5", "n_chars", F.sha2("__norm", 256).alias("group_hash"), *carry
    )
    alone = narrow.join(groups, keys, "left_anti").select(
        "__id", "text_md5", "n_chars", *carry
    )
    return _decided(materialize(hashed, "exact-hashed"), list(carry)).unionByName(
        alone.select(
            "__id",
            "text_md5",
            "n_chars",
            F.lit(None).cast("string").alias("group_hash"),
            F.col("__id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            *carry,
        )
    ).withColumnRenamed("__id", id_col)


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*keys)


def _decided(hashed: DataFrame, carry: list[str]) -> DataFrame:
    """Rows with equal full hash: the first by (most code points, id, text) stays."""
    # Repeated rows become one row and a count before anything is ordered.
    copies = hashed.groupBy("group_hash", "__id", "text_md5", "n_chars").agg(
        F.count(F.lit(1)).alias("__copies"), *[F.first(c).alias(c) for c in carry]
    )
    order = F.struct(
        (-F.col("n_chars")).alias("most"),
        F.col("__id").isNull().alias("last"),
        F.col("__id").alias("id"),
        F.col("text_md5").alias("md5"),
    )
    best = copies.groupBy("group_hash").agg(
        F.sum("__copies").alias("group_size"), F.min(order).alias("__best")
    )
    return (
        copies.join(best, "group_hash")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
        .select(
            "__id",
            "text_md5",
            "n_chars",
            "group_hash",
            F.col("__best.id").alias("keep_id"),
            "group_size",
            (
                F.col("__best.id").eqNullSafe(F.col("__id"))
                & (F.col("__best.md5") == F.col("text_md5"))
                & (F.col("__copy") == 1)
            ).alias("kept"),
            *carry,
        )
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows leave by an anti-join with the dropped ones, the minority. Where id and text are
    repeated, one of the rows stays.
    """
    decided = exact_groups(df, id_col, text_col)
    by_row = decided.groupBy(id_col, "text_md5").agg(
        F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")
    )
    special = by_row.filter("NOT __kept OR __rows > 1").select(
        F.col(id_col).alias("__id"), F.col("text_md5").alias("__md5"), "__kept"
    )
    special = materialize(special, "exact-special")
    tagged = df.withColumn("__text_md5", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_md5") == F.col("__md5"))
    plain = tagged.join(counted_side(special), same, "left_anti")
    repeated = materialize(special.filter("__kept"), "exact-repeated")
    one_of_many = tagged.join(counted_side(repeated), same, "left_semi").dropDuplicates(
        [id_col, "__text_md5"]
    )
    return plain.unionByName(one_of_many).drop("__text_md5")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays, for every document."""
    docs = load_table(spark, sf_dir, "documents")
    decided = exact_groups(docs, text_sha256=F.sha2(normalized(F.col("text")), 256))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), best AS (
  SELECT text_sha256, count(*) AS group_size,
         (array_agg(doc_id ORDER BY chars DESC, doc_id))[1] AS keep_id
  FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN best USING (text_sha256)
"""
