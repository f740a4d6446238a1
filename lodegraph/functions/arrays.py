"""Arrays as column expressions: values that are computed once, and running totals in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named: the only element of an array of one."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """Running totals of an array under an associative ``combine``, in work that is in proportion to the array.

    Totals run inside chunks; the last ones of the chunks are totalled in turn, and each chunk takes up the one before it.
    Expressions copy an array when they append to it, so none that grows is longer than a chunk (that of chunks aside).
    """

    def total(part: Column) -> Column:
        step = lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, combine(F.element_at(a, -1), x)).otherwise(x)))
        return F.aggregate(part, F.slice(part, 1, 0), step)

    def lifted(chunks: Column) -> Column:
        ends = total(F.transform(chunks, lambda c: F.element_at(c, -1)))
        whole = lambda before: F.transform(chunks, lambda c, i: F.when(i == 0, c).otherwise(F.transform(c, lambda x: combine(F.get(before, i - 1), x))))
        return F.when(F.size(chunks) == 1, chunks[0]).otherwise(bound(ends, lambda before: F.flatten(whole(before))))

    def scan(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))
        return F.when(F.size(v) == 0, v).otherwise(bound(F.transform(starts, lambda i: total(F.slice(v, i * chunk + 1, chunk))), lifted))

    return bound(values, scan)
