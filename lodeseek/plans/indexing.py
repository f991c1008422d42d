"""Index source trees: scan, chunk, embed, store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.chunking import chunks_of
from lodeseek.functions.text import embedding_text, embedding_windows, stored_content
from lodeseek.operators.inference import embed
from lodeseek.registry import DEFAULT_MODEL, ModelSpec, model_spec
from lodeseek.schemas import CHUNK_COLUMNS
from lodeseek.session import materialize
from lodeseek.sources.index_store import IndexStore, index_rows
from lodeseek.sources.repositories import (
    exclude_repos,
    indexable,
    list_repositories,
    list_tree,
    read_files,
    source_texts,
    tracked_only,
)


def chunk_files(files: DataFrame) -> DataFrame:
    """Source files (repo_name, rel_path, content, language) to chunk rows."""
    chunks = chunks_of(F.col("content"), F.col("rel_path"), F.col("language"))
    return files.select(
        "repo_name", F.col("rel_path").alias("file_path"), "language", F.explode(chunks).alias("c")
    ).select(
        "repo_name",
        "file_path",
        "c.chunk_type",
        "c.name",
        "c.content",
        "c.start_line",
        "c.end_line",
        "language",
    )


def embed_chunks(
    chunks: DataFrame, model: str | ModelSpec = DEFAULT_MODEL
) -> DataFrame:
    """Chunk rows with ``embedding``, of the heading and the first 500 characters.

    The stored content is cut as well, at 10,000. `embed_windows` takes whole chunks.
    """
    text = embedding_text(
        *[F.col(c) for c in ["chunk_type", "name", "content", "file_path", "language"]]
    )
    return (
        chunks.withColumn("embedding", embed(text, model, "document"))
        .withColumn("content", stored_content(F.col("content")))
        .select(*CHUNK_COLUMNS, "embedding")
    )


def embed_windows(chunks: DataFrame, model: str | ModelSpec = DEFAULT_MODEL) -> DataFrame:
    """Chunk rows, one for every window of the whole content, with ``window`` and ``embedding``.

    For searches (`multi_query_top_k` with ``windows``) that are to find what stands late in a long
    chunk. Contents are not carried on.
    """
    texts = embedding_windows(
        *[F.col(c) for c in ["chunk_type", "name", "content", "file_path", "language"]]
    )
    columns = [c for c in CHUNK_COLUMNS if c != "content"]
    parts = chunks.select(*columns, F.posexplode(texts).alias("window", "__text"))
    return parts.select(*columns, "window", embed(F.col("__text"), model, "document").alias("embedding"))


def rows_for_index(
    files: DataFrame, model: str | ModelSpec = DEFAULT_MODEL
) -> DataFrame:
    """Source files to index rows, checked against the store's limits."""
    spec = model_spec(model)
    return index_rows(embed_chunks(chunk_files(files), spec), spec)


def index_tree(
    spark: SparkSession,
    root: str,
    store: IndexStore,
    repo_name: str | None = None,
    model: str | ModelSpec = DEFAULT_MODEL,
    replace: bool = False,
    manifest: DataFrame | None = None,
    exclude: Iterable[str] = (),
) -> dict[str, int]:
    """Index one repository, or with no ``repo_name`` every one directly below ``root``.

    ``replace`` makes the result the whole content of the repositories that were listed,
    also of those in which nothing is left to index; without it known chunks are updated
    and new ones added, and chunks that are gone stay. A repository of which a directory
    could not be listed or a file not read is updated but not replaced, as the rest of it
    is unknown. Returns the numbers of files read, of chunks written, and of directories
    and files that ``failed``; `list_tree` and `read_files` tell which and why.
    """
    spec = model_spec(model)
    listing = exclude_repos(list_tree(spark, root, repo_name), exclude)
    listing = materialize(listing, "tree")
    unlisted = listing.filter("error IS NOT NULL").select("repo_name")
    wanted = indexable(tracked_only(listing.filter("error IS NULL"), manifest))
    files = read_files(wanted, root, repo_name is not None)
    if replace:
        # Errors have to be known before anything is replaced.
        files = materialize(files, "files")
    opened, read, made = Observation("opened"), Observation("files"), Observation("chunks")
    total = F.count(F.lit(1))
    files = files.observe(opened, F.count_if(F.col("error").isNotNull()).alias("failed"))
    texts = source_texts(files).observe(read, total.alias("files"))
    rows = rows_for_index(texts, spec).observe(made, total.alias("chunks"))
    if replace:
        rows = materialize(rows, "rows")
        if repo_name:
            repos = spark.createDataFrame([(repo_name,)], "repo_name string")
        else:
            repos = exclude_repos(list_repositories(spark, root), exclude)
        unread = files.filter("error IS NOT NULL").select("repo_name")
        broken = materialize(unlisted.unionByName(unread).distinct(), "broken")
        store.replace(
            rows.join(broken, "repo_name", "left_anti"),
            repos.join(broken, "repo_name", "left_anti"),
            spec.name,
        )
        rows = rows.join(broken, "repo_name", "left_semi")
        if not rows.isEmpty():
            store.upsert(rows)
    else:
        store.upsert(rows)
    failed = opened.get["failed"] + unlisted.count()
    return {**read.get, **made.get, "failed": failed}
