"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import chunking, formatting, hashing, text, vectors
from lodeseek.functions.arrays import to_matrix
from lodeseek.operators import cells, inference, merging, pooling, stats
from lodeseek.operators.joins import join_side
from lodeseek.operators.positions import batch_groups
from lodeseek.operators.quantising import ProductQuantiser
from lodeseek.operators.topk import cosine_top_k, multi_query_top_k
from lodeseek.plans import corpus
from lodeseek.plans.indexing import chunk_files, embed_chunks, embed_windows, index_tree
from lodeseek.plans.searching import query_vector, search_many, similarity
from lodeseek.registry import ModelSpec, model_spec
from lodeseek.schemas import INDEX_COLUMNS, NATURAL_KEY
from lodeseek.session import load_table, materialize, new_folder
from lodeseek.sources.index_store import IndexStore
from lodeseek.sources.repositories import (
    exclude_repos,
    indexable,
    list_tree,
    read_files,
    tracked_only,
    write_tree,
)
from lodeseek.sources.responses import parse_responses
from lodeseek.streaming.refresh import (
    failed_files,
    merge_changes,
    note_changes,
    refresh_index,
    state_tables,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


# --- search -----------------------------------------------------------------------


@registered
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to chunks to vectors; every benchmark text as a query, five chunks each."""
    index = embed_chunks(chunk_files(corpus.code_files(spark, sf_dir)), "e5")
    queries = load_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        inference.embed(F.col("text"), "e5", "query").alias("embedding"),
    )
    hits = multi_query_top_k(index, queries, 5, NATURAL_KEY)
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`search_chunks` over whole chunks: each is as near as the nearest of its windows."""
    parts = embed_windows(chunk_files(corpus.code_files(spark, sf_dir)), "e5")
    queries = load_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        inference.embed(F.col("text"), "e5", "query").alias("embedding"),
    )
    hits = multi_query_top_k(parts, queries, 5, NATURAL_KEY, windows=True)
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of one language nearest to every second benchmark text, by their windows."""
    parts = embed_windows(chunk_files(corpus.code_files(spark, sf_dir)), "e5")
    number = F.col("item_id")
    queries = load_table(spark, sf_dir, "benchmark").select(
        number.alias("query_id"),
        F.when(number % 2 == 0, "markdown").alias("language"),
        F.lit("file").alias("chunk_type"),
        inference.embed(F.col("text"), "e5", "query").alias("embedding"),
    )
    hits = multi_query_top_k(
        parts, queries, 3, NATURAL_KEY, filter_columns=["language", "chunk_type"], windows=True
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest whole documents for every benchmark text."""
    documents = corpus.documents(spark, sf_dir).select(
        "doc_id", inference.embed(F.col("text"), "minilm").alias("embedding")
    )
    queries = load_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        inference.embed(F.col("text"), "minilm", "query").alias("embedding"),
    )
    hits = multi_query_top_k(documents, queries, 3, ["doc_id"])
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def filtered_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries, two of three within a repository of their own."""
    index = corpus.documents(spark, sf_dir).select(
        "doc_id",
        F.col("source").alias("repo_name"),
        inference.embed(F.col("text"), "minilm").alias("embedding"),
    )
    number = F.col("item_id")
    queries = load_table(spark, sf_dir, "benchmark").select(
        number.alias("query_id"),
        F.when(
            number % 3 != 0, F.concat(F.lit("src"), (number % 20).cast("string"))
        ).alias("repo_name"),
        inference.embed(F.col("text"), "minilm", "query").alias("embedding"),
    )
    hits = multi_query_top_k(index, queries, 2, ["doc_id"], filter_columns=["repo_name"])
    return hits.withColumn("similarity", F.round("similarity", 6))


def _stored_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    vectors_ = load_table(spark, sf_dir, "embeddings")
    return vectors_.orderBy("vec_id").select("embedding").first().embedding


@registered
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors nearest to the first one, numbered."""
    stored = load_table(spark, sf_dir, "embeddings")
    hits = cosine_top_k(stored, _stored_vector(spark, sf_dir), 10, ["vec_id"])
    # A window over the k hits.
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id"))
    return hits.select("vec_id", "label", _rounded("similarity"), rank.alias("rank"))


@registered
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten Markdown files of one repository nearest to the first benchmark text."""
    first = load_table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    index = embed_chunks(chunk_files(corpus.code_files(spark, sf_dir)), "e5")
    hits = cosine_top_k(
        index,
        query_vector(spark, first, "e5"),
        10,
        repo_name="src3",
        language="markdown",
        chunk_type="file",
    )
    return hits.select("file_path", "name", "start_line", "end_line", _rounded("similarity"))


@registered
def dot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked against the first benchmark text."""
    first = load_table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    documents = corpus.documents(spark, sf_dir).select(
        F.col("doc_id").alias("position"), "text"
    )
    ranked = similarity(documents, first, "minilm")
    return ranked.select("position", _rounded("score"), "rank")


# --- approximate search -----------------------------------------------------------


def _label_cells(spark: SparkSession, sf_dir: str) -> tuple[cells.Cells, DataFrame, DataFrame]:
    """Cells around the mean vector of each label; stored vectors; the means as queries."""
    stored = load_table(spark, sf_dir, "embeddings")
    means = materialize(pooling.mean_vectors(stored, ["label"]), "means")
    around = cells.centroids_of(means, "label")
    return around, around.placed(stored), means.withColumnRenamed("label", "query_id")


@registered
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors nearest to each label's mean within the two nearest cells."""
    around, stored, queries = _label_cells(spark, sf_dir)
    hits = around.multi_query_top_k(stored, queries, 10, 2, ["vec_id"])
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ann_topk` on cells that were stored, loaded, added to and loaded again.

    Queries of an even label but 0 want that label only.
    """
    around, in_cells, queries = _label_cells(spark, sf_dir)
    vectors_, path = in_cells.drop("cell"), new_folder(spark, "cells")
    around.store(vectors_.filter("vec_id % 2 = 0"), path)
    cells.Cells.load(spark, path)[0].add(vectors_.filter("vec_id % 2 <> 0"), path)
    loaded, stored = cells.Cells.load(spark, path)
    wanted = F.when(F.col("query_id") % 2 == 0, F.col("query_id"))
    hits = loaded.multi_query_top_k(
        stored, queries.withColumn("label", wanted), 10, 2, ["vec_id"], filter_columns=["label"]
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the true ten nearest vectors that two cells hold, per query."""
    around, stored, queries = _label_cells(spark, sf_dir)
    near = around.multi_query_top_k(stored, queries, 10, 2, ["vec_id"])
    true = multi_query_top_k(stored, queries, 10, ["vec_id"])
    return cells.recall(true, near, ["vec_id"]).withColumn("recall", F.round("recall", 6))


@registered
def ann_trained_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sixteen cells, four of them searched; they begin with the first vectors
    by id and take three steps over all."""
    stored = load_table(spark, sf_dir, "embeddings")
    begun = cells.centroids_of(stored.orderBy("vec_id").limit(16), "vec_id")
    trained = cells.Cells.train(stored, 16, iterations=3, first=begun, tolerance=0.0)
    means = pooling.mean_vectors(stored, ["label"])
    queries = means.withColumnRenamed("label", "query_id")
    near = trained.multi_query_top_k(trained.placed(stored), queries, 10, 4, ["vec_id"])
    true = multi_query_top_k(stored, queries, 10, ["vec_id"])
    return cells.recall(true, near, ["vec_id"]).withColumn("recall", F.round("recall", 6))


def _label_codes(spark: SparkSession, sf_dir: str) -> tuple[ProductQuantiser, DataFrame, DataFrame]:
    """Label cells with code vectors from the sixteen vectors of the smallest ids; the vectors; queries."""
    around, in_cells, queries = _label_cells(spark, sf_dir)
    stored = in_cells.drop("cell")
    first = stored.orderBy("vec_id").limit(16).select("vec_id", "embedding").toArrow().sort_by("vec_id")
    rests = ProductQuantiser.rests(around, to_matrix(first.column("embedding"))[0])[1]
    books = rests.reshape(len(rests), 8, -1).transpose(1, 0, 2)
    return ProductQuantiser(around, books), stored, queries


@registered
def pq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each label's mean: the forty best of compressed vectors in three
    cells, compared exactly."""
    quantiser, stored, queries = _label_codes(spark, sf_dir)
    compressed = materialize(quantiser.compressed(stored), "compressed")
    hits = quantiser.top_k(compressed, stored, queries, 10, 3, ["vec_id"], count=40)
    return hits.withColumn("similarity", F.round("similarity", 6))


@registered
def pq_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty best estimates of each label's mean, as stored and loaded code vectors give them."""
    quantiser, stored, queries = _label_codes(spark, sf_dir)
    path = new_folder(spark, "codes")
    quantiser.save(spark, path)
    loaded = ProductQuantiser.load(spark, path)
    near = loaded.candidates(loaded.compressed(stored), queries, 40, 3, ["vec_id"])
    return near.withColumn("estimate", F.round("estimate", 6))


@registered
def pq_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the true ten nearest vectors that `pq_topk` finds, per query."""
    quantiser, stored, queries = _label_codes(spark, sf_dir)
    near = quantiser.top_k(quantiser.compressed(stored), stored, queries, 10, 3, ["vec_id"], count=40)
    true = multi_query_top_k(stored, queries, 10, ["vec_id"])
    return cells.recall(true, near, ["vec_id"]).withColumn("recall", F.round("recall", 6))


# --- vectors ----------------------------------------------------------------------


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "vec_id")
    return load_table(spark, sf_dir, "embeddings").join(labels, "vec_id", "left")


@registered
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label over the rows whose document is of good quality."""
    mask = F.coalesce(F.col("quality"), F.lit(0))
    means = pooling.masked_mean(_labelled_vectors(spark, sf_dir), ["label"], mask=mask)
    return means.select("label", "pos", _rounded("mean"))


@registered
def pool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as eight token vectors, pooled where a token starts positive."""
    tokens = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)
    )
    mask = F.transform(tokens, lambda t: (t[0] > 0).cast("int"))
    pooled = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.pool_tokens(tokens, mask).alias("pooled")
    )
    return pooled.select("vec_id", F.posexplode("pooled").alias("pos", "value")).select(
        "vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value")
    )


@registered
def pooled_or_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's own vector where its document is rated, else the mean of its label."""
    rows = _labelled_vectors(spark, sf_dir)
    means = pooling.mean_vectors(rows, ["label"], name="mean_vector")
    own = F.when(F.col("quality").isNotNull(), F.col("embedding").cast("array<double>"))
    chosen = join_side(rows, means, ["label"], 8 * 64).select(
        "vec_id", vectors.pooled_or_mean(own, F.col("mean_vector")).alias("v")
    )
    return chosen.select("vec_id", F.posexplode("v").alias("pos", "value")).select(
        "vec_id", "pos", _rounded("value")
    )


@registered
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stretched by their label, so that label 0 has zero vectors, made unit."""
    stretched = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    unit = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(vectors.l2_normalize(stretched)).alias("pos", "value")
    )
    return unit.select("vec_id", "pos", _rounded("value"))


@registered
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against its label's mean: dot product, similarity and distance."""
    stored = load_table(spark, sf_dir, "embeddings")
    means = pooling.mean_vectors(stored, ["label"], name="mean_vector")
    v, mean = F.col("embedding"), F.col("mean_vector")
    return join_side(stored, means, ["label"], 8 * 64).select(
        "vec_id",
        F.round(vectors.dot(v, mean), 6).alias("dot"),
        F.round(vectors.cosine_similarity(v, mean), 6).alias("similarity"),
        F.round(vectors.cosine_distance(v, mean), 6).alias("distance"),
    )


@registered
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text and read back."""
    back = vectors.text_to_vector(vectors.vector_to_text(F.col("embedding")))
    total = F.aggregate("back", F.lit(0.0), lambda a, x: a + x)
    return (
        load_table(spark, sf_dir, "embeddings")
        .select("vec_id", back.alias("back"))
        .select("vec_id", F.size("back").alias("dims"), F.round(total, 6).alias("total"))
    )


@registered
def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors per label, with those missing (label 5) or one short (label 3)."""
    vector = F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).when(
        F.col("label") != 5, F.col("embedding")
    )
    rows = load_table(spark, sf_dir, "embeddings").withColumn("embedding", vector)
    return merging.dimension_report(rows, 64, ["label"])


# --- text to vector ---------------------------------------------------------------


@registered
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per document; 256 of them as numbers, with padding and mask."""
    words = corpus.documents(spark, sf_dir).select(
        "doc_id", text.tokens(F.col("text")).alias("words")
    )
    ids = hashing.token_ids(F.slice("words", 1, 256))
    kept = words.select("doc_id", "words", ids.alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    mask = text.attention_mask(F.col("ids"), 256)
    return kept.select(
        "doc_id",
        F.size("words").alias("n_tokens"),
        F.size("ids").alias("n_kept"),
        total.alias("id_sum"),
        F.size(text.padded_ids(F.col("ids"), 256)).alias("n_padded"),
        F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
    )


@registered
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-zero components of every document's 64-component hashed vector."""
    spec = ModelSpec("hash64", dims=64)
    vector = corpus.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(inference.embed(F.col("text"), spec)).alias("dim", "value")
    )
    return vector.filter(F.col("value") != 0).select(
        "doc_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value")
    )


@registered
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two models are given for every chunk of every file."""
    chunks = chunk_files(corpus.code_files(spark, sf_dir))
    plain = text.embedding_text(
        *[F.col(c) for c in ["chunk_type", "name", "content", "file_path", "language"]]
    )
    return chunks.select(
        "file_path",
        "start_line",
        *[
            text.with_role_prefix(plain, model_spec(m), role).alias(f"{m}_{role}")
            for m, role in [("e5", "document"), ("e5", "query"), ("minilm", "document")]
        ],
    )


@registered
def content_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored part of every document."""
    documents = corpus.documents(spark, sf_dir)
    stored = documents.select("doc_id", text.stored_content(F.col("text")).alias("stored"))
    return stored.select(
        "doc_id", F.length("stored").alias("n_chars"), F.md5("stored").alias("digest")
    )


def _letter_model():
    """A small model: counts of four letters; refuses texts with license lines."""

    def predict(texts: np.ndarray) -> np.ndarray:
        if any("Licensed" in t for t in texts):
            raise ValueError("a license line")
        return np.array([[t.count(c) for c in "aeio"] for t in texts], dtype=np.float32)

    return predict


@registered
def model_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered model over all documents; those it refuses carry the error."""
    spec = ModelSpec("letters", dims=4, batch_size=16, make_predict_fn=_letter_model)
    rows = corpus.documents(spark, sf_dir).select(
        "doc_id", inference.try_embed(F.col("text"), spec).alias("r")
    )
    return rows.select(
        "doc_id",
        F.col("r.error").alias("error"),
        *[
            F.round(F.get("r.embedding", F.lit(i)).cast("double"), 5).alias(f"v{i}")
            for i in range(4)
        ],
    )


@registered
def dense_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 51 components of every vector under fixed weights."""
    make = inference.linear_model([1.0 / (i + 1) for i in range(51)])
    scored = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", inference.dense_score(F.slice("embedding", 1, 51), make).alias("score")
    )
    return scored.select("vec_id", F.round(F.col("score").cast("double"), 6).alias("score"))


@registered
def dedup_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts computed once per distinct text."""
    documents = corpus.documents(spark, sf_dir).select("doc_id", "text")
    counted = inference.score_once(
        documents, "text", lambda t: F.size(text.tokens(t)), "n_tokens"
    )
    return counted.select("doc_id", "n_tokens")


@registered
def cached_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts from a cache that outlives a run; ``fresh`` tells which texts the second run,
    over all documents, had to score after a first one over the English ones."""
    documents = corpus.documents(spark, sf_dir).select("doc_id", "lang", "text")
    count = lambda t: F.size(text.tokens(t))
    path = new_folder(spark, "score-cache")
    first = inference.ScoreCache(spark, path, "int", buckets=8)
    first.score(documents.filter("lang = 'en'"), "text", count, "n_tokens", run="first")
    second = inference.ScoreCache(spark, path, "int", buckets=8)
    counted = second.score(documents, "text", count, "n_tokens", run="second")
    return counted.select("doc_id", "n_tokens", (F.col("run") == "second").alias("fresh"))


# --- files and chunks -------------------------------------------------------------


@registered
def chunk_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and classes of every document as Python-like source."""
    documents = corpus.documents(spark, sf_dir)
    source = documents.select("doc_id", corpus.as_python(F.col("text"), F.col("doc_id")).alias("s"))
    found = source.select("doc_id", F.explode(chunking.python_definitions(F.col("s"))).alias("c"))
    return found.select(
        "doc_id",
        "c.chunk_type",
        "c.name",
        "c.start_line",
        "c.end_line",
        F.md5("c.content").alias("digest"),
    )


@registered
def chunk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one file chunk."""
    files = corpus.document_files(spark, sf_dir)
    chunk = chunking.file_chunk(F.col("content"), F.col("rel_path"))
    return files.select("doc_id", F.explode(chunk).alias("c")).select(
        "doc_id",
        "c.chunk_type",
        "c.name",
        "c.start_line",
        "c.end_line",
        F.length("c.content").alias("n_chars"),
    )


@registered
def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents as Python files, of which the English hold definitions."""
    files = corpus.document_files(spark, sf_dir)
    content = F.when(
        F.col("lang") == "en", corpus.as_python(F.col("content"), F.col("doc_id"))
    ).otherwise(F.col("content"))
    chunks = files.select(
        "doc_id",
        chunking.chunks_of(content, F.col("rel_path"), F.lit("python")).alias("chunks"),
    )
    return chunks.select(
        "doc_id",
        F.size("chunks").alias("n_chunks"),
        F.get("chunks", F.lit(0))["chunk_type"].alias("first_type"),
        F.get("chunks", F.lit(0))["name"].alias("first_name"),
        F.get("chunks", F.lit(0))["end_line"].alias("first_end"),
    )


@registered
def ext_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension and language of every page address and every document path."""
    pages = load_table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("path")
    )
    files = corpus.document_files(spark, sf_dir).select(
        F.lit("file").alias("kind"), F.col("doc_id").alias("id"), F.col("rel_path").alias("path")
    )
    path = F.col("path")
    return pages.unionByName(files).select(
        "kind", "id", text.extension(path).alias("extension"), text.language_of(path).alias("language")
    )


@registered
def skip_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document files that are indexed, with their language."""
    return indexable(corpus.document_files(spark, sf_dir)).select(
        "doc_id", "rel_path", "language"
    )


@registered
def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not blank, with German ones reduced to their white space."""
    content = F.when(
        F.col("lang") == "de", F.regexp_replace("content", r"[^ \n]", "")
    ).otherwise(F.col("content"))
    files = corpus.document_files(spark, sf_dir).withColumn("content", content)
    return files.filter(text.not_blank(F.col("content"))).select("doc_id", "lang")


@registered
def lenient_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes with broken sequences and mixed line ends, decoded."""
    broken = F.concat(
        F.unhex(F.lit("FFC328")),
        F.encode(F.replace("text", F.lit("\n"), F.lit("\r\n")), "UTF-8"),
        F.unhex(F.lit("EFBFBD0DE282")),
    )
    raw = F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.encode("text", "UTF-8"))
    decoded = corpus.documents(spark, sf_dir).select(
        "doc_id", text.lenient_utf8(raw).alias("t")
    )
    return decoded.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@registered
def manifest_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose document is rated good, by a manifest of paths."""
    files = corpus.document_files(spark, sf_dir)
    rated = load_table(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    manifest = files.join(rated, "doc_id").select("repo_name", "rel_path")
    return tracked_only(files, manifest).select("doc_id", "repo_name", "rel_path")


@registered
def exclude_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository without two excluded ones."""
    kept = exclude_repos(corpus.document_files(spark, sf_dir), ["src3", "src7"])
    return kept.groupBy("repo_name").agg(F.count(F.lit(1)).alias("files"))


# --- trees ------------------------------------------------------------------------


def _written_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a source tree of all documents: code files where the path has a language."""
    files = corpus.document_files(spark, sf_dir)
    python = corpus.as_python(F.col("content"), F.col("doc_id"))
    is_python = text.language_of(F.col("rel_path")) == "python"
    content = F.when(F.coalesce(is_python, F.lit(False)), python).otherwise(F.col("content"))
    root = new_folder(spark, "tree")
    write_tree(files.withColumn("content", content), root)
    return root


@registered
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree written from all documents, as its listing finds them."""
    found = list_tree(spark, _written_tree(spark, sf_dir))
    return found.select("repo_name", "rel_path", "size", F.col("error").isNotNull().alias("failed"))


@registered
def tree_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of known languages read after some, of documents rated toxic, were removed."""
    root = _written_tree(spark, sf_dir)
    listing = materialize(indexable(list_tree(spark, root).filter("error IS NULL")), "listing")
    write_tree(_removed(spark, sf_dir), root)
    return read_files(listing, root, False).select(
        "repo_name", "rel_path", F.length("content").alias("n_bytes"), F.col("error").isNotNull().alias("failed")
    )


def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of documents rated toxic, without contents."""
    toxic = load_table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    files = corpus.document_files(spark, sf_dir).join(toxic, "doc_id", "left_semi")
    return files.withColumn("content", F.lit(None).cast("string"))


@registered
def tree_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one indexing run over the tree counts, without two excluded repositories."""
    counted = index_tree(
        spark, _written_tree(spark, sf_dir), _new_store(spark), model=ModelSpec("hash64", dims=64),
        exclude=["src3", "src7"],
    )
    return spark.createDataFrame(
        [(counted["files"], counted["chunks"], counted["failed"])], "files bigint, chunks bigint, failed bigint"
    )


@registered
def refreshed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after two streamed refreshes, and the files that the second could not read.

    Between them rated documents change (but for Python files), and files appear for those rated
    toxic that are gone again when the stream comes to read them.
    """
    model = ModelSpec("hash64", dims=64)
    root, state, store = _written_tree(spark, sf_dir), new_folder(spark, "refresh-state"), _new_store(spark)
    _finished(refresh_index(spark, root, store, state, model=model))
    rated = load_table(spark, sf_dir, "labels")
    files = corpus.code_files(spark, sf_dir).filter("language <> 'python'")
    changed = files.join(rated.select("doc_id"), "doc_id", "left_semi").withColumn(
        "content", F.concat(F.lit("v2: "), "content")
    )
    write_tree(changed, root)
    brief = corpus.document_files(spark, sf_dir).join(rated.filter("toxic = 1"), "doc_id", "left_semi").withColumn(
        "rel_path", F.concat(F.lit("lib/gone_"), F.col("doc_id").cast("string"), F.lit(".go"))
    )
    write_tree(brief, root)
    listing = indexable(list_tree(spark, root).filter("error IS NULL"))
    note_changes(listing, *state_tables(state), files_per_batch=10_000, buckets=store.buckets)
    write_tree(brief.withColumn("content", F.lit(None).cast("string")), root)
    _finished(merge_changes(spark, root, store, state, model=model))
    indexed = store.read("hash64").select(
        *NATURAL_KEY, "end_line", F.md5("content").alias("digest"), F.lit(False).alias("failed")
    )
    none = {c: F.lit(None) for c in ("chunk_type", "name", "start_line", "end_line", "digest")}
    broken = failed_files(spark, state).select("repo_name", F.col("rel_path").alias("file_path")).distinct()
    return indexed.unionByName(
        broken.withColumns({c: v.cast(indexed.schema[c].dataType) for c, v in none.items()}).withColumn(
            "failed", F.lit(True)
        )
    )


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@registered
def decoded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as text: bytes of documents, every third of which are no UTF-8, and numbers."""
    raw = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(raw, F.unhex(F.lit("C328")))).otherwise(raw)
    decoded = corpus.documents(spark, sf_dir).select(
        "doc_id",
        text.decoded_text(broken).alias("t"),
        text.decoded_text(F.col("doc_id")).alias("number"),
    )
    return decoded.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), "number")


# --- index table ------------------------------------------------------------------


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select(
        *NATURAL_KEY,
        F.md5("content").alias("digest"),
        "end_line",
        "language",
        F.unix_seconds("indexed_at").alias("indexed_at"),
    )


def _stored_and_changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as index rows; rated ones changed, and all pages without a name."""
    stored = corpus.stored_rows(spark, sf_dir)
    rated = load_table(spark, sf_dir, "labels").select("doc_id")
    later = F.timestamp_seconds(F.lit(1735689600))
    changed = stored.join(rated, "doc_id", "left_semi").select(
        "repo_name",
        "file_path",
        "chunk_type",
        "name",
        F.concat(F.lit("v2: "), "content").alias("content"),
        "start_line",
        (F.col("end_line") + 100).alias("end_line"),
        F.lit("zz").alias("language"),
        later.alias("indexed_at"),
    )
    pages = load_table(spark, sf_dir, "pages").select(
        F.lit("web").alias("repo_name"),
        F.col("url").alias("file_path"),
        F.lit("file").alias("chunk_type"),
        F.lit(None).cast("string").alias("name"),
        F.col("html").alias("content"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.lit("html").alias("language"),
        later.alias("indexed_at"),
    )
    return stored.drop("doc_id"), changed.unionByName(pages)


@registered
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored; rated ones changed, and all pages added without a name."""
    return _digested(merging.merge_index(*_stored_and_changed(spark, sf_dir)))


def _new_store(spark: SparkSession) -> IndexStore:
    """A store of its own for one run, below the shared folder."""
    return IndexStore(spark, new_folder(spark, "store"), buckets=4)


def _with_vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"embedding": F.array(F.lit(1.0).cast("float")), "model": F.lit("one")}
    ).select(*INDEX_COLUMNS)


@registered
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`index_upsert` through a store on disk, read again."""
    store = _new_store(spark)
    stored, changed = _stored_and_changed(spark, sf_dir)
    store.upsert(_with_vectors(stored))
    store.upsert(_with_vectors(changed))
    return _digested(store.read("one"))


@registered
def stored_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`index_replace` through a store on disk, read again."""
    store = _new_store(spark)
    stored = corpus.stored_rows(spark, sf_dir)
    rated = load_table(spark, sf_dir, "labels").select("doc_id")
    store.upsert(_with_vectors(stored))
    new = stored.filter("repo_name = 'src3'").join(rated, "doc_id", "left_semi")
    repos = spark.createDataFrame([("src3",), ("src7",)], "repo_name string")
    changed = new.withColumn("content", F.concat(F.lit("v2: "), "content"))
    store.replace(_with_vectors(changed), repos, "one")
    return _digested(store.read("one"))


@registered
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest documents of a stored index for every benchmark text, with contents."""
    store = _new_store(spark)
    rows = corpus.stored_rows(spark, sf_dir)
    vectors_ = rows.withColumns(
        {"embedding": inference.embed(F.col("content"), "minilm"), "model": F.lit("minilm")}
    )
    store.upsert(vectors_.select(*INDEX_COLUMNS))
    queries = load_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )
    hits = search_many(store, queries, 3, "minilm")
    return hits.select(
        "query_id", "rank", "file_path", _rounded("similarity"), F.md5("content").alias("digest")
    )


@registered
def stored_cells_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`stored_search` in the two nearest of eight cells of the index.

    The cells lie around the documents of the smallest ids. Half of the documents are written
    before the index has cells, half after.
    """
    store = _new_store(spark)
    rows = corpus.stored_rows(spark, sf_dir)
    vectors_ = rows.withColumns(
        {"embedding": inference.embed(F.col("content"), "minilm"), "model": F.lit("minilm")}
    )
    store.upsert(vectors_.filter("doc_id % 2 = 0").select(*INDEX_COLUMNS))
    around = cells.centroids_of(vectors_.orderBy("doc_id").limit(8), "doc_id")
    store.set_cells("minilm", around)
    store.upsert(vectors_.filter("doc_id % 2 <> 0").select(*INDEX_COLUMNS))
    queries = load_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text"
    )
    hits = search_many(store, queries, 3, "minilm", probes=2)
    return hits.select(
        "query_id", "rank", "file_path", _rounded("similarity"), F.md5("content").alias("digest")
    )


@registered
def index_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository replaced by its rated documents, and one emptied."""
    stored = corpus.stored_rows(spark, sf_dir)
    rated = load_table(spark, sf_dir, "labels").select("doc_id")
    new = (
        stored.filter(F.col("repo_name") == "src3")
        .join(rated, "doc_id", "left_semi")
        .withColumn("content", F.concat(F.lit("v2: "), "content"))
    )
    replaced = merging.replace_groups(stored.drop("doc_id"), new.drop("doc_id"), ["src3", "src7"])
    return _digested(replaced)


@registered
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows and latest date per repository."""
    return stats.index_summary(corpus.stored_rows(spark, sf_dir))


@registered
def index_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all files."""
    return stats.index_total(chunk_files(corpus.code_files(spark, sf_dir)))


@registered
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one store, those not rated toxic in the other."""
    stored = corpus.stored_rows(spark, sf_dir)
    toxic = load_table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return merging.reconcile(stored, stored.join(toxic, "doc_id", "left_anti"))


@registered
def reconcile_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by which two stores differ: documents rated toxic are missing in the second one, others
    that are rated have another content, and pages are new."""
    stored, changed = _stored_and_changed(spark, sf_dir)
    toxic = load_table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select("doc_id")
    kept = corpus.stored_rows(spark, sf_dir).join(toxic, "doc_id", "left_semi").select(*NATURAL_KEY)
    second = merging.merge_index(stored, changed).join(
        kept, ["repo_name", "file_path", "chunk_type", "name", "start_line"], "left_anti"
    )
    first, second = _with_vectors(stored), _with_vectors(second)
    return merging.content_difference(first, second)


@registered
def result_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document shown as a search result, with scores from -0.3 to 1."""
    hits = corpus.stored_rows(spark, sf_dir).withColumn(
        "similarity", (F.col("doc_id") * 37 % 1301) / F.lit(1000.0) - F.lit(0.3)
    )
    named = hits.withColumn("name", F.when(F.col("language") != "fr", F.col("name")))
    return named.select(
        "doc_id",
        formatting.result_text().alias("shown"),
        formatting.result_text(show_content=False).alias("heading"),
    )


@registered
def parse_saved_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in answers of ten, alternately of either shape, read back in order."""
    answers = (
        load_table(spark, sf_dir, "embeddings")
        .groupBy(F.floor(F.col("vec_id") / 10).alias("batch_id"))
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((F.col("vec_id") % 10).alias("index"), F.col("embedding"))
                )
            ).alias("items")
        )
    )
    ordered = F.to_json(F.struct(F.col("items.embedding").alias("embeddings")))
    shuffled = F.to_json(F.struct(F.reverse("items").alias("data")))
    body = F.when(F.col("batch_id") % 2 == 0, ordered).otherwise(shuffled)
    parsed = parse_responses(answers.select("batch_id", body.alias("body")))
    total = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double")
    )
    return parsed.select(
        "batch_id", "position", F.size("embedding").alias("dims"), F.round(total, 6).alias("total")
    )


# --- statistics -------------------------------------------------------------------


@registered
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency summary per batch size."""
    summary = stats.latency_stats(corpus.latency_samples(spark, sf_dir))
    numbers = [c for c in summary.columns if c not in ("batch_size", "iterations")]
    return summary.select("batch_size", "iterations", *[_rounded(c) for c in numbers])


@registered
def throughput_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput per number of workers over the wall time."""
    summary = stats.throughput_stats(corpus.timed_requests(spark, sf_dir))
    exact = ("workers", "total_requests", "total_sentences")
    return summary.select(*exact, *[_rounded(c) for c in summary.columns if c not in exact])


@registered
def batch_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type as a run of sentences, encoded in batches of sixteen."""
    runs = (
        load_table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("sentences"),
            (F.sum("value") / 1000.0).alias("elapsed_sec"),
        )
    )
    summary = stats.batch_throughput(runs, 16, ["event_type"])
    return summary.select(
        "event_type", "batches", "encoded", _rounded("throughput", 4), _rounded("ms_per_batch", 4)
    )


@registered
def batch_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every source in batches of 32."""
    documents = corpus.documents(spark, sf_dir).select("source", "doc_id")
    return batch_groups(documents, ["doc_id"], 32, ["source"])
