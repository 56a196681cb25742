"""Column expressions on ``array<double>``: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x) -> Column:
    """Cast to ``array<double>``."""
    return col(x).cast("array<double>")


def vector(values) -> Column:
    """A literal array of doubles."""
    return F.array(*(F.lit(float(v)) for v in values))


def total(x) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda s, v: s + v)


def dot(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def norm(x, p: float = 2) -> Column:
    """Vector norm for p = 1, 2 or infinity."""
    x = col(x)
    if p == 1:
        return total(F.transform(x, F.abs))
    if p == float("inf"):
        return F.array_max(F.transform(x, F.abs))
    return F.sqrt(total(F.transform(x, lambda v: v * v)))


def normalize(x, eps: float = EPS) -> Column:
    """x / (norm + eps)."""
    n = norm(x) + eps
    return F.transform(col(x), lambda v: v / n)


def scale(x, s) -> Column:
    return F.transform(col(x), lambda v: v * s)


def add(x, y) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a + b)


def subtract(x, y) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a - b)


def mean(x) -> Column:
    return total(x) / F.size(col(x))


def center(x) -> Column:
    m = mean(x)
    return F.transform(col(x), lambda v: v - m)


def soft_threshold(x, t) -> Column:
    """sign(x) max(|x| - t, 0), element-wise."""
    return F.transform(col(x), lambda v: F.signum(v) * F.greatest(F.abs(v) - t, F.lit(0.0)))


def matvec(rows, x) -> Column:
    """Products of the vectors in ``rows`` (array of arrays) with x."""
    return F.transform(col(rows), lambda r: dot(r, x))


def combine(rows, a) -> Column:
    """Sum of the vectors in ``rows`` weighted by a: linear decoding."""
    terms = F.zip_with(col(rows), col(a), lambda r, w: scale(r, w))
    zero = F.transform(F.element_at(col(rows), 1), lambda v: v * 0.0)
    return F.aggregate(terms, zero, add)


def matmul(a, b) -> Column:
    """Product of two matrices given as arrays of rows."""
    return F.transform(col(a), lambda r: combine(b, r))


def matrix(rows) -> Column:
    """A literal matrix, as an array of rows."""
    return F.array(*(vector(r) for r in rows))


def eye(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: (i == j).cast("double")))


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def outer(x, y) -> Column:
    return F.transform(col(x), lambda v: scale(y, v))


def count_active(x, threshold: float = 1e-15) -> Column:
    return F.size(F.filter(col(x), lambda v: F.abs(v) > threshold))


def all_finite(x) -> Column:
    """False if any element is null, NaN or infinite."""
    return F.coalesce(F.forall(col(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def reshape(x, width: int) -> Column:
    """Rows of ``width`` elements."""
    x = col(x)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / width).cast("int") - 1), lambda i: F.slice(x, i * width + 1, width))


def minmax(x) -> Column:
    """(x - min) / (max - min), zeros for a constant vector."""
    x = col(x)
    lo, hi = F.array_min(x), F.array_max(x)
    return F.transform(x, lambda v: F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0))


def gershgorin(gram) -> Column:
    """Upper bound of the largest eigenvalue of a symmetric matrix: largest absolute row sum."""
    return F.array_max(F.transform(col(gram), lambda r: norm(r, 1)))
