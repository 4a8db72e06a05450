"""Expressions on dense vectors held as arrays, and on log probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when one side has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a) -> Column:
    n = norm(a)
    return F.transform(_col(a), lambda x: x.cast("double") / n)


def dirichlet(tf, doc_len, p_collection, mu: float) -> Column:
    """Dirichlet-smoothed probability of a term in a document."""
    return (_col(tf) + F.lit(float(mu)) * _col(p_collection)) / (_col(doc_len) + F.lit(float(mu)))


def jelinek_mercer(tf, doc_len, p_collection, lam: float) -> Column:
    """Jelinek-Mercer mix of document and collection probability of a term."""
    own = F.when(_col(doc_len) > 0, _col(tf) / _col(doc_len)).otherwise(F.lit(0.0))
    return F.lit(1.0 - lam) * own + F.lit(float(lam)) * _col(p_collection)
