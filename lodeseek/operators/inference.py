"""Running a model over a column: embedding, scoring, reuse of equal inputs, errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import unit_rows
from lodeseek.functions.hashing import hash_embed
from lodeseek.functions.text import first_words, with_role_prefix
from lodeseek.registry import ModelSpec, PredictFn, model_spec
from lodeseek.session import materialize

VECTOR = T.ArrayType(T.FloatType())
VECTOR_OR_ERROR = "embedding array<float>, error string"


def embed(text: Column, model: str | ModelSpec, role: str = "document") -> Column:
    """Unit vector of a text under a model, with the model's prefix for the role.

    A registered prediction function is loaded once per Python worker and called on
    batches of the model's size, with the first ``max_length`` words of a text if the model has such a
    limit; a model without a function uses the token-hashing embedder, which takes whole texts.
    """
    spec = model_spec(model)
    prefixed = with_role_prefix(text, spec, role)
    if spec.make_predict_fn is None:
        return hash_embed(prefixed, spec.dims)
    prefixed = _within_limit(prefixed, spec)
    predict = predict_batch_udf(
        _checked(spec.make_predict_fn, spec.dims), return_type=VECTOR, batch_size=spec.batch_size
    )
    return predict(prefixed)


def _within_limit(text: Column, spec: ModelSpec) -> Column:
    return text if spec.max_length is None else first_words(text, spec.max_length)


def _checked(make_predict_fn: Callable[[], PredictFn], dims: int) -> Callable[[], PredictFn]:
    """The prediction function with unit vectors, one of ``dims`` per input or an error."""

    def make() -> PredictFn:
        predict = make_predict_fn()

        def run(texts: np.ndarray) -> np.ndarray:
            return _as_vectors(predict(texts), len(texts), dims)

        return run

    return make


def _as_vectors(predicted: np.ndarray, inputs: int, dims: int) -> np.ndarray:
    vectors = np.asarray(predicted, dtype=np.float32)
    if len(vectors) != inputs:
        raise RuntimeError(f"{inputs} texts went in, {len(vectors)} vectors came out")
    if inputs and vectors.shape[1] != dims:
        raise RuntimeError(f"the model's vectors have {vectors.shape[1]} components, not {dims}")
    # Models may or may not normalize; afterwards cosine and dot product agree.
    return unit_rows(vectors.astype(np.float64)).astype(np.float32) if inputs else vectors


def try_embed(text: Column, model: str | ModelSpec, role: str = "document") -> Column:
    """struct(embedding, error): a text that cannot be embedded does not fail the others.

    A batch that fails is tried again text by text, so one bad text costs only its own
    vector.
    """
    spec = model_spec(model)
    if spec.make_predict_fn is None:
        raise ValueError(f"model {spec.name!r} has no prediction function")
    make, dims, size = spec.make_predict_fn, spec.dims, spec.batch_size

    @F.pandas_udf(VECTOR_OR_ERROR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = make()

        def attempt(texts: np.ndarray) -> tuple[list, list]:
            try:
                return list(_as_vectors(predict(texts), len(texts), dims)), [None] * len(texts)
            except Exception as error:
                if len(texts) == 1:
                    return [None], [f"not embedded: {error}"]
            parts = [attempt(texts[i : i + 1]) for i in range(len(texts))]
            return [v for p in parts for v in p[0]], [e for p in parts for e in p[1]]

        for batch in batches:
            texts = batch.to_numpy()
            done = [attempt(texts[i : i + size]) for i in range(0, len(texts), size)]
            yield pd.DataFrame(
                {
                    "embedding": [v for d in done for v in d[0]],
                    "error": [e for d in done for e in d[1]],
                }
            )

    return run(_within_limit(with_role_prefix(text, spec, role), spec))


def split_errors(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``embedding``, and rows with their ``error``."""
    others = [c for c in df.columns if c != result]
    good = df.filter(F.col(f"{result}.error").isNull())
    bad = df.filter(F.col(f"{result}.error").isNotNull())
    return (
        good.select(*others, F.col(f"{result}.embedding").alias("embedding")),
        bad.select(*others, F.col(f"{result}.error").alias("error")),
    )


def dense_score(
    features: Column,
    make_predict_fn: Callable[[], PredictFn],
    inputs: int = 51,
    batch_size: int = 1024,
) -> Column:
    """One float per row of a fixed number of features.

    A model that takes no more rows at a time gets them in batches of ``batch_size``.
    """
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.FloatType(),
        batch_size=batch_size,
        input_tensor_shapes=[[inputs]],
    )
    return predict(features)


def linear_model(weights: Sequence[float]) -> Callable[[], PredictFn]:
    """A prediction function for `dense_score` with fixed weights."""
    fixed = np.asarray(weights, dtype=np.float64)

    def make() -> PredictFn:
        return lambda rows: (rows.astype(np.float64) @ fixed).astype(np.float32)

    return make


def score_once(
    df: DataFrame, column: str, score: Callable[[Column], Column], name: str = "score"
) -> DataFrame:
    """Add ``score(column)``, computed once per distinct value of the column.

    Values meet by their SHA-256 digest (NULL has one of its own), so the join compares
    and carries no texts. Copies are merged before the shuffle. The way back is a left
    join whose large side Spark splits where one value holds many rows.
    """
    text = F.col(column).cast("string")
    digest = F.coalesce(F.sha2(text, 256), F.lit("NULL"))
    one_each = df.groupBy(digest.alias("__digest")).agg(F.first(column).alias("__value"))
    scored = one_each.select("__digest", score(F.col("__value")).alias(name))
    return (
        df.withColumn("__row_digest", digest)
        .join(scored, F.col("__row_digest") == F.col("__digest"), "left")
        .drop("__row_digest", "__digest")
    )


class ScoreCache:
    """Scores of values kept below ``path``, for this run and later ones.

    The cache is a table of (digest, score, run) in ``buckets`` by digest, so a join of other
    digests reads it in place: only what is asked for is shuffled. ``score_type`` is the type of a
    score, ``buckets`` stays the same for a cache. A cache has one writer at a time; should two
    have scored the same value, either score counts.
    """

    def __init__(self, spark: SparkSession, path: str, score_type: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = f"score_cache_{md5(self.path.encode()).hexdigest()}"
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, score {score_type}, run STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def known(self) -> DataFrame:
        """One row per digest."""
        self.spark.catalog.refreshTable(self.name)
        either = F.max(F.struct("run", "score")).alias("kept")
        return self.spark.table(self.name).groupBy("digest").agg(either).select("digest", "kept.score", "kept.run")

    def score(
        self, df: DataFrame, column: str, score: Callable[[Column], Column], name: str = "score",
        run: str = "",
    ) -> DataFrame:
        """Add ``score(column)`` and the ``run`` that computed it; only values not known yet are scored.

        Values meet by their SHA-256 digest (NULL has one of its own); texts are shuffled only if they
        are new, once per distinct one. New scores are appended before the result is
        built, so a run that fails later has kept them.
        """
        digest = F.coalesce(F.sha2(F.col(column).cast("string"), 256), F.lit("NULL"))
        known = self.known().select(F.col("digest").alias("__known"))
        digests = df.select(digest.alias("__digest")).distinct()
        missing = digests.join(known, F.col("__digest") == F.col("__known"), "left_anti")
        missing = materialize(missing, "missing")
        if missing.take(1):
            values = df.select(digest.alias("__digest"), F.col(column).alias("__value"))
            values = values.join(missing, "__digest", "left_semi").groupBy("__digest")
            fresh = values.agg(F.first("__value").alias("__value")).select(
                F.col("__digest").alias("digest"), score(F.col("__value")).alias("score"), F.lit(run).alias("run")
            )
            (
                fresh.repartition(self.buckets, "digest")
                .write.mode("append")
                .bucketBy(self.buckets, "digest")
                .sortBy("digest")
                .format("parquet")
                .option("path", self.path)
                .saveAsTable(self.name)
            )
        scored = self.known().select(F.col("digest").alias("__digest"), F.col("score").alias(name), "run")
        return df.withColumn("__row_digest", digest).join(
            scored, F.col("__row_digest") == F.col("__digest"), "left"
        ).drop("__row_digest", "__digest")

    def forget(self) -> None:
        """Take the table out of the session's catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
