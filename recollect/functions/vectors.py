"""Vector columns (arrays of numbers), in double precision."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: what a lambda refers to by its expression is worked out again for every element."""
    return F.transform(F.array(value), use)[0]


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def normalised(v: Column) -> Column:
    """v at length one; the zero vector stays."""
    scaled = lambda x, norm: F.transform(x, lambda e: F.when(norm > 0, e.cast("double") / norm).otherwise(e.cast("double")))
    return bound(v, lambda x: bound(F.sqrt(squared_norm(x)), lambda norm: scaled(x, norm)))


def added(a: Column, b: Column) -> Column:
    """The sum over the places that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") + y.cast("double"))


def similarity(squared_distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + squared_distance)
