"""Search an index or a table of texts with queries in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions.formatting import result_text
from lodeseek.operators.cells import Cells, CellTree
from lodeseek.operators.inference import embed
from lodeseek.operators.topk import (
    FILTER_COLUMNS,
    multi_query_top_k,
    rank_all,
    search_stored,
)
from lodeseek.registry import DEFAULT_MODEL, ModelSpec, model_spec
from lodeseek.schemas import CHUNK_COLUMNS, NATURAL_KEY
from lodeseek.session import materialize
from lodeseek.sources.index_store import PLACE, IndexStore


# Files of hits that a scan is told in a list.
FILES_LISTED = 1000


def _cells_of(store: IndexStore, spec: ModelSpec) -> Cells | CellTree:
    cells = store.cells(spec.name)
    if cells is None:
        raise ValueError(f"the index has no cells for {spec.name!r}")
    return cells


def query_vector(
    spark: SparkSession, text: str, model: str | ModelSpec = DEFAULT_MODEL
) -> list[float]:
    """The vector of one query text, embedded as stored texts are."""
    one = spark.createDataFrame([(text,)], "text string")
    return one.select(embed(F.col("text"), model, "query").alias("v")).first().v


def search(
    store: IndexStore,
    query: str,
    limit: int = 10,
    repo_name: str | None = None,
    language: str | None = None,
    chunk_type: str | None = None,
    model: str | ModelSpec = DEFAULT_MODEL,
    probes: int | None = None,
) -> DataFrame:
    """The ``limit`` chunks nearest to a query, best first, among those of the filters.

    With ``probes`` only so many cells of the index are searched, those nearest to the query;
    their folders, and those of the wanted repository, are all that is opened.
    """
    spec = model_spec(model)
    vector = query_vector(store.spark, query, spec)
    index = store.read(spec.name, cells=probes is not None)
    if probes is not None:
        index = index.filter(F.col("cell").isin(_cells_of(store, spec).probed(vector, probes)))
    return search_stored(
        index,
        vector,
        limit,
        repo_name=repo_name,
        language=language,
        chunk_type=chunk_type,
    )


def search_many(
    store: IndexStore,
    queries: DataFrame,
    limit: int = 10,
    model: str | ModelSpec = DEFAULT_MODEL,
    contents: bool = True,
    probes: int | None = None,
) -> DataFrame:
    """`search` for every row (query_id, text, optional filter columns) at once.

    Returns the hits of each query with their ``rank``; without ``contents`` only the key
    and the similarity of each, which saves a second look at the index. Contents are read
    from the files of the hits, if these are few, else joined by file and row.
    """
    spec = model_spec(model)
    index = store.read(spec.name, places=True, cells=probes is not None)
    # Rows without a full natural key may be stored more than once: the place tells them apart.
    key = [*NATURAL_KEY, *PLACE]
    vectors = queries.withColumn("embedding", embed(F.col("text"), spec, "query"))
    filters = [c for c in FILTER_COLUMNS if c in queries.columns]
    if probes is not None:
        cells = _cells_of(store, spec)
        hits = cells.multi_query_top_k(index, vectors, limit, probes, key, filter_columns=filters)
    else:
        hits = multi_query_top_k(index, vectors, limit, key, filter_columns=filters)
    if not contents:
        return hits.drop(*PLACE)
    hits = materialize(hits.select("query_id", "rank", "similarity", *PLACE), "hits")
    files = [r.file for r in hits.select("file").distinct().limit(FILES_LISTED + 1).collect()]
    if len(files) <= FILES_LISTED:
        index = index.filter(F.col("file").isin(files))
    return index.select(*PLACE, *CHUNK_COLUMNS).join(hits, PLACE).select(
        "query_id", "rank", *CHUNK_COLUMNS, "similarity"
    )


def formatted(hits: DataFrame, show_content: bool = True) -> DataFrame:
    """Hits (at most the search limit) numbered from the best, with their ``text``."""
    order = [F.desc_nulls_last("similarity"), *[F.asc_nulls_last(c) for c in NATURAL_KEY]]
    # One window over all hits: they are no more than the limit of the search.
    result = F.row_number().over(Window.orderBy(*order))
    return hits.withColumn("result", result).withColumn("text", result_text(show_content))


def similarity(
    documents: DataFrame,
    query: str,
    model: str | ModelSpec = DEFAULT_MODEL,
    text: str = "text",
    position: str = "position",
    carry: Sequence[str] = (),
) -> DataFrame:
    """All documents with their score and rank against a query, ties by position.

    ``carry`` names further columns of the documents to keep.
    """
    spec = model_spec(model)
    vectors = documents.withColumn("embedding", embed(F.col(text), spec, "document"))
    wanted = query_vector(documents.sparkSession, query, spec)
    return rank_all(vectors, wanted, [position], carry=carry)
