"""Vector arithmetic on ``array<double>`` columns (F5, F6). Lengths must agree; a null side gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def _col(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(DOUBLES)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column | str, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(_col(a), lambda x: x / n)


def cosine(a: Column | str, b: Column | str, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def scale(a: Column | str, by: Column | float) -> Column:
    return F.transform(_col(a), lambda x: x * by)


def weighted_merge(a: Column | str, n_a: Column | str, b: Column | str, n_b: Column | str) -> Column:
    """Mean of two means by their counts; the first where both counts are zero (A5)."""
    wa, wb = (F.col(x) if isinstance(x, str) else x for x in (n_a, n_b))
    return F.when(wa + wb == 0, _col(a)).otherwise(F.zip_with(_col(a), _col(b), lambda x, y: (x * wa + y * wb) / (wa + wb)))
