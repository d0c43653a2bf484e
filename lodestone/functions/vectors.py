"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this divide by it instead, so a zero vector stays zero.
TINY = 1e-12


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda v: v.cast("double") * v.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, value: total + value))


def unit(vector: Column, kind: str = "float") -> Column:
    """The vector scaled to length one, stored as ``kind``."""
    scaled = F.transform(
        F.array(F.greatest(norm(vector), F.lit(TINY))),
        lambda size: F.transform(vector, lambda v: (v / size).cast(kind)),
    )
    return F.get(scaled, F.lit(0))
