"""Vector expressions on ``array<float|double>`` columns (JVM side, no UDF).

Embeddings are stored as ``array<float>``; arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# cosine similarity floors the norm at this value, so a zero vector has cosine 0
NORM_EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def norm(v) -> Column:
    d = as_double(v)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    d = as_double(v)
    n = F.greatest(norm(d), F.lit(NORM_EPS))
    return F.transform(d, lambda x: x / n)


def dot(a, b, dim: int | None = None) -> Column:
    """Dot product; with a known length it is a plain sum of products (generated code)."""
    if dim is not None:
        x, y = _c(a), _c(b)
        return sum_of([x[i].cast("double") * y[i].cast("double") for i in range(int(dim))])
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def sum_of(terms: list[Column]) -> Column:
    """Balanced sum of many column terms (keeps the expression tree shallow)."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i]
                 for i in range(0, len(terms), 2)]
    return terms[0]


def norm_fixed(v, dim: int) -> Column:
    """L2 norm of a vector of known length (element casts, no array copy)."""
    x = _c(v)
    return F.sqrt(sum_of([x[i].cast("double") * x[i].cast("double") for i in range(int(dim))]))


def scaled_fixed(v, factor: Column, dim: int) -> Column:
    """Vector of known length divided by ``factor`` (a column computed once)."""
    x = _c(v)
    return F.array(*[x[i].cast("double") / factor for i in range(int(dim))])


def vector_sum(v, weight: str | None = None, dim: int | None = None) -> Column:
    """Aggregate: element-wise sum of equal-length arrays (partial + final, JVM).

    With a known length ``dim`` the sum is ``dim`` plain ``sum`` aggregates
    (fixed-width buffers, generated code, map-side partial aggregation); without
    it, Spark ML's ``Summarizer`` (several times slower per row) is used.
    """
    if dim is not None:
        x = _c(v)
        w = None if weight is None else F.col(weight).cast("double")
        return F.array(*[F.sum(x[i].cast("double") if w is None else x[i].cast("double") * w)
                         for i in range(int(dim))])
    c = as_double(v)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    w = None if weight is None else F.col(weight).cast("double")
    return vector_to_array(Summarizer.sum(array_to_vector(c), w))


def of_length(v, dim: int) -> Column:
    """The vector itself; a row with a vector of another length (or none) ends the query."""
    x = _c(v)
    message = F.concat(F.lit(f"a vector has not the length {int(dim)} but "),
                       F.coalesce(F.size(x).cast("string"), F.lit("none")))
    return F.when(F.size(x) == int(dim), x).otherwise(F.raise_error(message))
