"""Chains of equi-joins of two or more tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.select import S, Select

if TYPE_CHECKING:
    from quern.operators.table import Table


def _bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of a result."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class Side:
    """One table of a join, by whose names a program refers to columns."""

    def __init__(self, alias: str, columns: list[str]):
        self.alias, self.columns = alias, columns

    def __getitem__(self, name: str) -> Column:
        if name not in self.columns:
            raise KeyError(f"{name} is none of {self.columns}")
        return F.col(f"{self.alias}.`{name}`")

    def all(self) -> Select:
        return S.extend(*(self[c] for c in self.columns))

    def all_with_prefix(self, prefix: str) -> Select:
        return S.extend(*(self[c].alias(prefix + c) for c in self.columns))


class Join:
    """A left-deep chain. Missing keys match nothing; the keys of both sides stay apart.

    Each further table is joined to the key of the first, or of the table numbered
    ``against`` (from 0). Key types must agree.
    """

    #: Bytes up to which a side that was called small is broadcast, by the size its plan is estimated at.
    SMALL = 64 << 20

    def __init__(self, table: Table, key: str, more: tuple = ()):
        self.table, self.key, self.more = table, key, more

    def _and(self, how: str, table: Table, key: str, against: int, small: bool) -> Join:
        left_table, left_key = ((self.table, self.key), *((t, k) for _, t, k, _, _ in self.more))[against]
        a, b = dict(left_table.df.dtypes)[left_key], dict(table.df.dtypes)[key]
        if a != b:
            raise ValueError(f"key {left_key} is {a} and {key} is {b}")
        return Join(self.table, self.key, (*self.more, (how, table, key, against, small)))

    def inner(self, table: Table, key: str, *, against: int = 0, small: bool = False) -> Join:
        return self._and("inner", table, key, against, small)

    def left(self, table: Table, key: str, *, against: int = 0, small: bool = False) -> Join:
        return self._and("left", table, key, against, small)

    def right(self, table: Table, key: str, *, against: int = 0, small: bool = False) -> Join:
        return self._and("right", table, key, against, small)

    def outer(self, table: Table, key: str, *, against: int = 0, small: bool = False) -> Join:
        return self._and("full", table, key, against, small)

    def select(self, program: Callable[..., Select]) -> Table:
        """``program`` gets a :class:`Side` for each table; its predicate filters joined rows.

        ``small`` on a side asks for a broadcast. It is heeded only where the plan
        of that side is estimated at no more than ``SMALL`` bytes; elsewhere sizes
        decide while the query runs.
        """
        from quern.operators.table import Table

        tables = [self.table, *(t for _, t, _, _, _ in self.more)]
        keys = [self.key, *(k for _, _, k, _, _ in self.more)]
        sides = [Side(f"t{i}", t.columns) for i, t in enumerate(tables)]
        df = self.table.df.alias("t0")
        for i, (how, table, key, against, small) in enumerate(self.more, start=1):
            other = F.broadcast(table.df) if small and _bytes(table.df) <= self.SMALL else table.df
            df = df.join(other.alias(f"t{i}"), sides[against][keys[against]] == sides[i][key], how)
        s = program(*sides)
        df = df if s.predicate is None else df.where(s.predicate)
        return Table(df.select(*s.columns))
