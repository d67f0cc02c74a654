"""Column helpers for dense vectors stored as ``array<float|double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def dot(a, b) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """M3: cosine in double precision; zero norm (or null) -> 0.0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_pool(vectors) -> Column:
    """M2 mean pooling: element-wise mean of an ``array<array<...>>`` (token vectors)."""
    v = _col(vectors)
    width = F.size(F.get(v, 0))
    sums = F.aggregate(
        v, F.array_repeat(F.lit(0.0).cast("double"), width),
        lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q.cast("double")))
    return F.transform(sums, lambda s: s / F.size(v))


def cls_pool(vectors) -> Column:
    """M2 CLS pooling: the first token vector."""
    return F.get(_col(vectors), 0)
