"""Queries over the given tables, one module per family of operators."""

from . import (  # noqa: F401
    corpus_queries,
    emd_queries,
    entity_queries,
    join_queries,
    label_queries,
    metric_queries,
    ml_queries,
    profile_queries,
    retrieval_queries,
    scalar_queries,
    source_queries,
)
from .registry import QUERIES, SQL  # noqa: F401
