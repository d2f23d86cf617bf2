"""Vector arithmetic on ``array<double>`` columns with Spark higher-order functions.

These stay inside the JVM (no Python per row). Arrays of different lengths
raise through ``assert_true`` instead of silently giving 0 as a plain loop
would.

Rule: a lambda never captures a computed column. Catalyst may inline the
producing expression into the lambda body, which then re-evaluates it for
every element (a dot product per component is O(dim^2) per row). Per-row
scalars enter through ``zip_with`` with ``array_repeat`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The logistic is clipped to exactly 0 at or below -6 and to
# exactly 1 at or above 6.
LOGISTIC_CLIP = 6.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return _col(c).cast("array<double>")


def same_length(a, b) -> Column:
    """Raises at runtime when the two arrays differ in length."""
    a, b = _col(a), _col(b)
    ok = a.isNull() | b.isNull() | (F.size(a) == F.size(b))
    return F.assert_true(ok, F.lit("vectors differ in length"))


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    prod = F.zip_with(a, b, lambda x, y: x * y)
    checked = F.when(same_length(a, b).isNull(), prod)
    return F.aggregate(checked, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    a = _col(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives null (sorted last), not an error."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def add(a, b) -> Column:
    a, b = _col(a), _col(b)
    summed = F.zip_with(a, b, lambda x, y: x + y)
    return F.when(same_length(a, b).isNull(), summed)


def sub(a, b) -> Column:
    a, b = _col(a), _col(b)
    diff = F.zip_with(a, b, lambda x, y: x - y)
    return F.when(same_length(a, b).isNull(), diff)


def scale(a, s) -> Column:
    """Every component times ``s`` (a number or a per-row column)."""
    a = _col(a)
    if not isinstance(s, Column):
        lit = F.lit(float(s))
        return F.transform(a, lambda x: x * lit)
    return F.zip_with(a, F.array_repeat(s.cast("double"), F.size(a)), lambda x, y: x * y)


def divide(a, s) -> Column:
    """Every component divided by the per-row column ``s``."""
    a = _col(a)
    return F.zip_with(a, F.array_repeat(s.cast("double"), F.size(a)), lambda x, y: x / y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def clipped_logistic(x) -> Column:
    """1 / (1 + e^-x), exactly 0 at x <= -6 and exactly 1 at x >= 6.

    ``x`` is referenced three times: pass a column, not a costly expression.
    """
    x = _col(x)
    return (F.when(x <= -LOGISTIC_CLIP, F.lit(0.0))
            .when(x >= LOGISTIC_CLIP, F.lit(1.0))
            .otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(-x))))


def round_vec(a, digits: int = 6) -> Column:
    return F.transform(_col(a), lambda x: F.round(x, digits))
