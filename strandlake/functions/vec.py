"""Dense vectors (arrays of numbers) and sparse ones (maps from feature to number)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _fits(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or unequally long vectors and for two zero vectors; NaN if just one is zero."""
    na, nb = dot(a, a), dot(b, b)
    value = F.coalesce(F.try_divide(dot(a, b), F.sqrt(na) * F.sqrt(nb)), F.lit(float("nan")))
    return F.when(_fits(a, b), F.when((na == 0) & (nb == 0), F.lit(0.0)).otherwise(value)).otherwise(F.lit(0.0))


def euclid_similarity(a: Column, b: Column) -> Column:
    """1 - the distance; 0 for null, empty or unequally long vectors."""
    d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(_fits(a, b), 1 - F.sqrt(d)).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, metric: str) -> Column:
    return {"cosine": cosine, "euclidean": euclid_similarity}.get(metric, lambda *_: F.lit(0.0))(a, b)


def l2_normalize(v: Column) -> Column:
    """A map's values over their Euclidean norm; null values for a zero vector."""
    norm = F.sqrt(_sum(F.transform(F.map_values(v), lambda x: x.cast("double") * x.cast("double"))))
    # bound to a name, or every value would have the norm computed anew
    return F.get(F.transform(F.array(norm), lambda n: F.transform_values(v, lambda _, x: F.try_divide(x.cast("double"), n))), F.lit(0))


def sparse_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two maps over the union of their keys; a missing key is 0."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return F.sqrt(_sum(F.map_values(F.map_zip_with(a, b, lambda _, x, y: (zero(x) - zero(y)) * (zero(x) - zero(y))))))
