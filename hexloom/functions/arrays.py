"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    """The sum of an array of longs."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running_sums(values: Column, block: int = 64) -> Column:
    """For each element the sum of those before it (longs).

    Sums go by blocks, so that n elements take about n * (block + n / block**2) steps.
    """

    def within(part: Column, head: Column) -> Column:
        return F.transform(part, lambda x, i: head + total(F.slice(part, F.lit(1), i)))

    def numbered(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def from_parts(parts: Column) -> Column:
        def from_sums(sums: Column) -> Column:
            heads = F.transform(sums, lambda x, i: total(F.slice(sums, F.lit(1), i)))
            return F.flatten(F.zip_with(parts, heads, within))

        return let(F.transform(parts, total), from_sums)

    def from_values(v: Column) -> Column:
        blocks = F.ceil(F.size(v) / block).cast("int")
        return let(F.transform(numbered(blocks), lambda b: F.slice(v, b * block + 1, F.lit(block))), from_parts)

    return let(F.transform(values, lambda x: x.cast("long")), from_values)
