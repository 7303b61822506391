"""Grouping and its reductions."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.select import Select, as_select

if TYPE_CHECKING:
    from quern.operators.table import Table


class Grouping:
    """Rows by key. A missing key is a group of its own.

    A program is a select list of aggregates; its predicate keeps groups.
    Columns that are neither aggregates nor keys are an analysis error.
    """

    def __init__(self, table: Table, keys: tuple[Column, ...]):
        self.table, self.keys = table, keys

    def by(self, *keys: Column | str) -> Grouping:
        return Grouping(self.table, (*self.keys, *(F.col(k) if isinstance(k, str) else k for k in keys)))

    def _reduced(self, program: Select, keys: tuple[Column, ...]) -> Table:
        from quern.operators.table import Table

        df, n = self.table.df, len(keys)
        extra = [] if program.predicate is None else [program.predicate.alias("__keep")]
        df = df.groupBy(*keys).agg(*program.columns, *extra)
        names = df.columns[n : n + len(program.columns)]  # the keys come first, maybe by the same names
        df = df.toDF(*(f"__c{i}" for i in range(len(df.columns))))
        df = df.where(f"__c{len(df.columns) - 1}") if extra else df
        return Table(df.select(*(F.col(f"__c{n + i}").alias(c) for i, c in enumerate(names))))

    def reduce_total(self, *program: Column | Select) -> Table:
        """One row a group."""
        return self._reduced(as_select(program), self.keys)

    def reduce_partial(self, *program: Column | Select) -> Table:
        """Rows that a total by the same keys reduces to what :meth:`reduce_total` gives.

        Spark reduces by group in each partition before it deals the rest by key,
        so what comes out is whole already, at the cost of one exchange of partial
        rows; a total by these keys afterwards finds the rows in place and adds none.
        """
        return self._reduced(as_select(program), self.keys)

    def count(self, *program: Column | Select) -> Table:
        """One row: the number of groups for which the predicate of the program holds."""
        from quern.operators.table import Table

        s = as_select(program)
        if s.predicate is None:
            groups = self.table.df.select(*(k.alias(f"__c{i}") for i, k in enumerate(self.keys))).distinct()
        else:
            groups = self._reduced(Select((F.lit(1).alias("__one"),), s.predicate), self.keys).df
        return Table(groups.agg(F.count(F.lit(1)).alias("count")))
