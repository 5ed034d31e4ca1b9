"""Binding an expression to a name inside a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b as double; ``empty`` where b is 0."""
    b = b.cast("double")
    return F.when(b != 0, a.cast("double") / F.when(b != 0, b)).otherwise(F.lit(empty).cast("double"))
