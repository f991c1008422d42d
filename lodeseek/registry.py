"""Embedding models by name.

A model is a dimension, the prefixes for its two roles, a limit and a batch size.
``make_predict_fn`` loads real weights inside a Python worker, and is given at most
``max_length`` words of a text (None: all of it); without it the built-in token-hashing embedder
supplies vectors of the model's dimension, of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

PredictFn = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class ModelSpec:
    name: str
    dims: int
    prefix: str = ""
    query_prefix: str = ""
    max_length: int | None = None
    batch_size: int = 32
    make_predict_fn: Callable[[], PredictFn] | None = None

    def role_prefix(self, role: str) -> str:
        if role == "document":
            return self.prefix
        if role == "query":
            return self.query_prefix
        raise ValueError(f"unknown role {role!r}: use 'document' or 'query'")


DEFAULT_MODEL = "e5"

# Dimensions, prefixes, token limits and batch caps per model (fixed values).
MODELS: dict[str, ModelSpec] = {
    "minilm": ModelSpec("minilm", dims=384, max_length=256, batch_size=32),
    "e5": ModelSpec(
        "e5", dims=1024, prefix="passage: ", query_prefix="query: ", max_length=256, batch_size=16
    ),
    "arctic": ModelSpec("arctic", dims=768, max_length=8192, batch_size=32),
}


def register_model(spec: ModelSpec) -> ModelSpec:
    """Make a model available under its name, replacing an earlier one."""
    MODELS[spec.name] = spec
    return spec


def model_spec(model: str | ModelSpec) -> ModelSpec:
    if isinstance(model, ModelSpec):
        return model
    try:
        return MODELS[model]
    except KeyError:
        raise ValueError(f"unknown model {model!r}; known: {sorted(MODELS)}") from None
