"""Select lists: the columns a query gives and the rows it keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Select:
    """Columns and, at will, a predicate. Immutable; every method gives a new list."""

    columns: tuple[Column, ...] = ()
    predicate: Column | None = None

    def extend(self, *columns: Column | str) -> Select:
        return Select((*self.columns, *(F.col(c) if isinstance(c, str) else c for c in columns)), self.predicate)

    def where(self, predicate: Column) -> Select:
        """Repeated predicates must all hold."""
        return Select(self.columns, predicate if self.predicate is None else self.predicate & predicate)

    def concat(self, other: Select) -> Select:
        """The columns of both; the predicates of both must hold."""
        out = Select((*self.columns, *other.columns), self.predicate)
        return out if other.predicate is None else out.where(other.predicate)


#: The empty select list.
S = Select()


def as_select(columns: tuple) -> Select:
    if len(columns) == 1 and isinstance(columns[0], Select):
        return columns[0]
    return S.extend(*columns)
