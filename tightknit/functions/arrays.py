"""Column helpers over neighbor arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<bigint>"


def empty_list() -> Column:
    return F.array().cast(EMPTY)


def ordered_intersect(left, right) -> Column:
    """Elements of ``left`` that are also in ``right``, in the order of ``left``.

    ``array_intersect`` builds a hash set of its right side and walks the left
    one, so the order of the left side survives. The level steps slice arrays by
    position and rely on that; ``tests/test_arrays.py`` pins it.
    """
    return F.array_intersect(left, right)


def after(array, pos) -> Column:
    """Elements that follow the 0-based position ``pos``."""
    array = F.col(array) if isinstance(array, str) else array
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.slice(array, pos + 2, F.size(array))


def computed(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """``df`` with ``keep`` and the given columns, each evaluated once per row.

    A filter on a projected column is pushed below the projection with the
    column's expression copied into it, so an array intersection would run again
    for every mention. Filters do not move below a generator, which makes the
    one-row ``inline`` a boundary for them.
    """
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return df.select(*keep, F.inline(F.array(row)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used inside."""
    return F.transform(F.array(value), use)[0]
