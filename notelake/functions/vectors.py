"""Vector arithmetic on arrays, in double precision and array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """Null for a zero vector."""
    # the norm is bound by a transform of its own, so that it is not taken anew for every component
    each = lambda n: F.when(n > 0, F.transform(c(a), lambda x: (x / n).cast("float")))
    return F.get(F.transform(F.array(norm(a)), each), F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def similarity(cos: Column) -> Column:
    """1 - d**2 / 2 with d the squared distance of unit vectors: the score that the vector store reports."""
    return 1 - 2 * (1 - cos) * (1 - cos)
