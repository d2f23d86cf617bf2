"""Array helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often the result
    refers to it (also inside other lambdas)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def value_counts(values: Column) -> Column:
    """``array<struct<value, cnt>>`` of the distinct values, ascending: the
    run boundaries of the sorted array."""
    def of(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), n - 1),
                         lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(
            F.get(s, i).alias("value"),
            (F.coalesce(F.get(f, k + 1), n) - i).cast("bigint").alias("cnt"))))
    return F.when(F.size(values) > 0, let(F.sort_array(values), of))
