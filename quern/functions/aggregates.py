"""Aggregates of groups. All but :func:`has_missing` and the flags skip missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.values import col


def total(x: str | Column) -> Column:
    """The sum; of ints as a long, which doesn't wrap."""
    return F.sum(col(x))


def count(x: str | Column) -> Column:
    return F.count(col(x))


def mean(x: str | Column) -> Column:
    return F.avg(col(x))


def least(x: str | Column) -> Column:
    return F.min(col(x))


def greatest(x: str | Column) -> Column:
    return F.max(col(x))


def first(x: str | Column) -> Column:
    """Some value of the group that isn't missing; which one depends on the order rows arrive in.

    For a column that is constant in each group, such as a key, use :func:`key`.
    """
    return F.last(col(x), ignorenulls=True)


def key(x: str | Column) -> Column:
    """A column the rows are grouped by: the grouping column itself, which costs no aggregate."""
    return col(x)


def has_missing(x: str | Column) -> Column:
    return F.max(col(x).isNull().cast("int"))


def count_distinct(x: str | Column) -> Column:
    return F.count_distinct(col(x))


def all_true(x: str | Column) -> Column:
    """1 where no flag of the group is 0 or missing."""
    return F.min(F.coalesce(col(x) != 0, F.lit(False)).cast("int"))


def any_true(x: str | Column) -> Column:
    """1 where a flag of the group is 1."""
    return F.max(F.coalesce(col(x) == 1, F.lit(False)).cast("int"))


def none_true(x: str | Column) -> Column:
    return F.lit(1) - any_true(x)
