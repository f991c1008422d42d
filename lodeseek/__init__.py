"""Semantic search over code and text as Spark jobs."""

import sys

from pyspark import cloudpickle

from lodeseek.registry import MODELS, ModelSpec, model_spec, register_model
from lodeseek.session import build_session, load_table

# Functions travel to Python workers with their code, so that executors need no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "MODELS",
    "ModelSpec",
    "build_session",
    "load_table",
    "model_spec",
    "register_model",
]
