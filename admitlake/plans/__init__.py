"""All queries of the library but those of the training-data subpackage."""

from . import assistant, corpus, predicting, training, upkeep
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assistant", "corpus", "predicting", "training", "upkeep"]
