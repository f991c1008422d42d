"""Source files, index rows and request records derived from the given tables.

The tables hold no source code, so documents stand in for files: the source is the
repository, the path follows from the id, and a document with a Python path has its
lines replaced by definitions, comments, blanks and indented text in a fixed rotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import language_of
from lodeseek.session import load_table, spread

# Directories and file name endings given to documents in turn.
# Every skipped directory and every known ending is among them; the two numbers of
# entries have no common divisor, so all pairs occur.
DIRECTORIES = [
    "src", "lib/core", "docs", "app", "pkg/x", "tests", "node_modules/a", ".git", "__pycache__",
    ".venv/lib", "venv", "dist", "build", ".next", ".cache/y", "pkg/vendor/x", "target",
]
ENDINGS = [
    ".py", ".js", ".go", ".md", ".txt", ".PY", ".tsx", ".ts", ".jsx", ".py", ".rs", ".java",
    ".cpp", ".c", ".h", ".rb", ".php", ".sql", ".sh",
]


def _in_turn(values: list[str], number: Column) -> Column:
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (number % len(values)).cast("int") + 1)


def document_path() -> Column:
    number = F.col("doc_id")
    return F.concat(
        _in_turn(DIRECTORIES, number),
        F.lit("/doc_"),
        number.cast("string"),
        _in_turn(ENDINGS, number),
    )


def as_python(text: Column, number: Column) -> Column:
    """A text with each line replaced by one of a rotation of Python-like lines."""

    def line_for(line: Column, i: Column) -> Column:
        turn = (number * 7 + i * 3) % 11
        position = i.cast("string")
        return (
            F.when(turn == 0, F.concat(F.lit("def f"), position, F.lit("(x):")))
            .when(turn == 1, F.concat(F.lit("class C"), position, F.lit(":")))
            .when(turn == 2, F.concat(F.lit("    def m"), position, F.lit("(self):")))
            .when(turn == 3, F.lit("# note"))
            .when(turn == 4, F.lit(""))
            .when(turn == 5, F.lit("\ty = 1"))
            .when(turn == 6, F.lit("x = 2"))
            .otherwise(F.concat(F.lit("    "), line))
        )

    return F.array_join(F.transform(F.split(text, "\n", -1), line_for), "\n")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over enough tasks for costly work on each."""
    return spread(load_table(spark, sf_dir, "documents"), "doc_id")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: doc_id, lang, repo_name, rel_path, content."""
    return documents(spark, sf_dir).select(
        "doc_id",
        "lang",
        F.col("source").alias("repo_name"),
        document_path().alias("rel_path"),
        F.col("text").alias("content"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a language; those with a Python path hold Python-like lines."""
    files = document_files(spark, sf_dir).withColumn("language", language_of(F.col("rel_path")))
    python = as_python(F.col("content"), F.col("doc_id"))
    return files.filter(F.col("language").isNotNull()).withColumn(
        "content", F.when(F.col("language") == "python", python).otherwise(F.col("content"))
    )


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of an index without vectors, indexed one hour apart."""
    lines = F.size(F.split("content", "\n", -1))
    return document_files(spark, sf_dir).select(
        "doc_id",
        "repo_name",
        F.col("rel_path").alias("file_path"),
        F.lit("file").alias("chunk_type"),
        F.substring_index("rel_path", "/", -1).alias("name"),
        "content",
        F.lit(1).alias("start_line"),
        lines.alias("end_line"),
        F.col("lang").alias("language"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("indexed_at"),
    )


# The batch sizes and worker counts that event types stand for.
BATCH_SIZES = {"view": 1, "click": 4, "purchase": 8, "signup": 16, "error": 32}
WORKERS = {"view": 1, "click": 2, "purchase": 4, "signup": 8, "error": 16}


def _of_event(values: dict[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(known, F.col("event_type"))


def latency_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as latency samples; those of the first hour are the warm-up."""
    events = load_table(spark, sf_dir, "events")
    warm = F.col("ts").cast("timestamp") < F.timestamp_seconds(F.lit(1704070800))
    return events.select(
        _of_event(BATCH_SIZES).alias("batch_size"),
        F.when(warm, "warmup").otherwise("measure").alias("phase"),
        F.col("event_id").alias("iteration"),
        F.col("value").alias("latency_ms"),
    )


def timed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of four sentences that start at ``ts`` and take ``value`` ms."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    took = F.round(F.col("value") * 1000).cast("bigint")
    return load_table(spark, sf_dir, "events").select(
        _of_event(WORKERS).alias("workers"),
        F.timestamp_micros(start).alias("start_ts"),
        F.timestamp_micros(start + took).alias("end_ts"),
        F.lit(4).alias("sentences"),
    )
