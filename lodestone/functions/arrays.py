"""Scans and searches over array columns whose cost does not grow with the square.

A fold that appends to an array copies it at every step. These take a number of
whole passes that grows with the logarithm of the length instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row: a lambda variable cannot
    be duplicated when the optimizer merges projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sum of each integer and all before it, by adding up over doubling distances."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))
    start = F.transform(values, lambda x: x.cast("int"))

    def step(sums, r):
        back = F.pow(F.lit(2.0), r).cast("int")
        return F.transform(sums, lambda x, i: (x + F.coalesce(F.get(sums, i - back), F.lit(0))).cast("int"))

    return F.aggregate(steps, start, step)


def count_below(ascending: Column, value: Column) -> Column:
    """How many entries of an ascending array are smaller than ``value``, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high"))

    def step(acc, _):
        low, high = acc["low"], acc["high"]
        middle = F.shiftright(low + high, 1)
        right = (low < high) & (F.get(ascending, middle) < value)
        return F.struct(
            F.when(right, middle + 1).otherwise(low).alias("low"),
            F.when(right | (low >= high), high).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + 1.0)).cast("int"))
    return F.aggregate(steps, start, step, lambda acc: acc["low"])


def where(values: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """Ascending indexes of the entries for which ``holds(entry, index)``."""
    return F.filter(F.transform(values, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())
