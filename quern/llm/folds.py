"""Running values over arrays, and parts of long strings, by DataFrame expressions.

A fold that adds to an array copies it at every step, and a place in a string is
found from its start, so the plain forms cost the square of an array or string.
Here both are cut into chunks first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``f`` (associative) makes of all before it, from ``zero`` on."""

    def of(v: Column) -> Column:
        def chunk(t: Column, c: Column) -> Column:
            inside = lambda own, off: F.transform(own, lambda y, i: f(off, F.aggregate(F.slice(own, F.lit(1), i), zero, f)))
            return let(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), lambda own: let(F.aggregate(F.slice(t, F.lit(1), c), zero, f), lambda off: inside(own, off)))

        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        totals = F.transform(numbers, lambda c: F.aggregate(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), zero, f))
        whole = let(totals, lambda t: F.flatten(F.transform(t, lambda x, c: chunk(t, c))))
        return F.when(F.size(v) > 0, whole).otherwise(F.slice(v, F.lit(1), F.lit(0)))

    return let(values, of)


def parts(text: Column, n: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` of a function that gives a part of ``text`` (start from 0, length), for about ``n`` parts."""
    width = F.greatest(F.ceil(F.length(text) / F.sqrt(F.greatest(n, F.lit(1)))).cast("int"), F.lit(1))

    def of(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / w).cast("int")), lambda c: F.substring(text, c * w + 1, w))

        def part(chunks: Column, start: Column, size: Column) -> Column:
            first, last = F.floor(start / w).cast("int"), F.floor((start + size) / w).cast("int")
            near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            return F.substring(near, (start - first * w + 1).cast("int"), size.cast("int"))

        return let(cut, lambda chunks: body(lambda start, size: part(chunks, start, size)))

    return let(width, of)
