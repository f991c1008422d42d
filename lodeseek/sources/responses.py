"""Saved answers of an embedding service as rows of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.schemas import EMBEDDING_RESPONSE


def response_vectors(parsed: Column) -> Column:
    """Vectors of one parsed answer in input order.

    Answers are ``{"embeddings": [[...], ...]}``, already ordered, or
    ``{"data": [{"index": i, "embedding": [...]}, ...]}`` in any order.
    """
    by_index = F.transform(F.array_sort(parsed["data"]), lambda d: d["embedding"])
    return F.coalesce(parsed["embeddings"], by_index).cast("array<array<float>>")


def parse_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per vector: the other columns, ``position`` from 0, ``embedding``."""
    others = [c for c in responses.columns if c != body]
    # A column of its own, so that an answer is parsed once for both shapes.
    parsed = responses.select(*others, F.from_json(body, EMBEDDING_RESPONSE).alias("__parsed"))
    return parsed.select(
        *others, F.posexplode(response_vectors(F.col("__parsed"))).alias("position", "embedding")
    )


def response_errors(
    responses: DataFrame, dims: int, expected: str = "inputs", body: str = "body"
) -> DataFrame:
    """``responses`` with ``error``: a wrong number of vectors or a wrong dimension."""
    parsed = F.from_json(body, EMBEDDING_RESPONSE)
    vectors = F.coalesce(response_vectors(parsed), F.array().cast("array<array<float>>"))
    sizes = F.transform(vectors, F.size)
    wrong = F.get(F.filter(sizes, lambda s: s != dims), F.lit(0))
    message = F.when(
        F.size(vectors) != F.col(expected),
        F.format_string(
            "%d texts went in, %d vectors came out", F.col(expected), F.size(vectors)
        ),
    ).when(wrong.isNotNull(), F.format_string(f"a vector has %d components, not {dims}", wrong))
    return responses.withColumn("error", message)
