"""Small builders for expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block of the running sum below.
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once for each row.

    A column named inside a lambda would be evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running_sum(numbers: Column) -> Column:
    """Sum up to and including each element, in about n times the square root of n."""

    def of(xs: Column) -> Column:
        def with_base(base: Column) -> Column:
            return F.transform(xs, lambda x, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + total(F.slice(xs, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK + 1).cast("int"))))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))
        base = let(blocks, lambda sums: F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b))))
        return F.when(F.size(xs) == 0, F.transform(xs, lambda x: x.cast("long"))).otherwise(let(base, with_base))

    return let(numbers, of)
