"""A table: a DataFrame with the operators of the query language.

Every operator builds a logical plan and nothing more; Catalyst prunes columns,
pushes predicates into scans, plans partial aggregates and chooses joins.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.values import present, to_instant
from quern.operators.grouping import Grouping
from quern.operators.joining import Join
from quern.operators.select import Select, as_select

log = logging.getLogger(__name__)


class Table:
    def __init__(self, df: DataFrame):
        self.df = df

    # -- making tables ---------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, schema: dict[str, str] | None = None, *, clean: bool = False) -> Table:
        """Wrap a DataFrame: NaN becomes missing and timestamps become UTC instants of milliseconds.

        ``schema`` (name -> Spark type) is checked against what the DataFrame has.
        ``clean`` vouches that no double is NaN and leaves all columns as they
        are, so that predicates on them reach the scan.
        """
        if schema is not None and (got := dict(df.dtypes)) != schema:
            raise ValueError(f"expected {schema}, got {got}")
        if clean:
            return cls(df)
        change = {}
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                change[f.name] = present(F.col(f"`{f.name}`"))
            elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
                change[f.name] = to_instant(F.col(f"`{f.name}`"))
        return cls(df.withColumns(change) if change else df)

    def __getitem__(self, name: str | int) -> Column:
        return self.df[self.df.columns[name] if isinstance(name, int) else name]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # -- select lists -------------------------------------------------------------

    def all(self) -> Select:
        return Select(tuple(F.col(f"`{c}`") for c in self.columns))

    def all_with_prefix(self, prefix: str) -> Select:
        return Select(tuple(F.col(f"`{c}`").alias(prefix + c) for c in self.columns))

    # -- rows ---------------------------------------------------------------------

    def query(self, *columns: Column | str | Select) -> Table:
        """Filter, then project. A program of constants alone, or of another table's columns, is refused."""
        s = as_select(columns)
        try:
            df = self.df if s.predicate is None else self.df.where(s.predicate)
            out = df.select(*s.columns)
        except AnalysisException as e:
            if (e.getCondition() or "").startswith("MISSING_ATTRIBUTES"):
                raise ValueError("a program must keep to the columns of one table") from e
            raise
        if s.predicate is None and out._jdf.queryExecution().analyzed().references().isEmpty():
            raise ValueError("a program must use a column of its table")
        return Table(out)

    def where(self, predicate: Column) -> Table:
        return Table(self.df.where(predicate))

    filter = where

    def count(self, predicate: Column | None = None) -> Table:
        """One row: the number of rows for which the predicate holds."""
        df = self.df if predicate is None else self.df.where(predicate)
        return Table(df.agg(F.count(F.lit(1)).alias("count")))

    def rename(self, *names: str) -> Table:
        if len(names) != len(self.columns):
            raise ValueError(f"{len(self.columns)} names are needed, {len(names)} given")
        return Table(self.df.toDF(*names))

    def concat(self, *others: Table) -> Table:
        """All rows of all tables, which must agree in names and types."""
        df = self.df
        for o in others:
            if o.df.dtypes != self.df.dtypes:
                raise ValueError(f"tables differ: {self.df.dtypes} and {o.df.dtypes}")
            df = df.unionAll(o.df)
        return Table(df)

    def let(self, body) -> Table:
        """``body`` of this table: a name for a step that is used more than once."""
        return body(self)

    def tap(self, tag: str, size: int = 50) -> Table:
        """Log a sample and go on."""
        log.info("%s\n%s", tag, self.sample(size))
        return self

    def show_sample(self, size: int = 100) -> str:
        """Some rows as text."""
        return self.df.limit(size).toPandas().to_string(index=False)

    def sample(self, size: int = 50) -> list[Row]:
        return self.df.limit(size).collect()

    # -- aggregates -------------------------------------------------------------------

    def reduce(self, *aggregates: Column | Select) -> Table:
        """One row for the whole table; a predicate of the list filters that row."""
        s = as_select(aggregates)
        df = self.df.agg(*s.columns)
        return Table(df if s.predicate is None else df.where(s.predicate))

    def partial_reduce(self, *aggregates: Column | Select) -> Table:
        """A row that a further reduction takes to what :meth:`reduce` gives; see :meth:`Grouping.reduce_partial`."""
        return self.reduce(*aggregates)

    def group_by(self, *keys: Column | str) -> Grouping:
        return Grouping(self, tuple(F.col(k) if isinstance(k, str) else k for k in keys))

    def distinct(self, *columns: Column | str) -> Table:
        return Table((self.df.select(*columns) if columns else self.df).distinct())

    # -- joins -------------------------------------------------------------------------

    def on(self, key: str) -> Join:
        """Start a chain of equi-joins on this column: ``a.on("k").inner(b, "k").select(...)``."""
        return Join(self, key)

    # -- top k ------------------------------------------------------------------------

    def top_k(self, column: str, k: int, *, ascending: bool = True, approximate: bool = False, accuracy: int = 10_000, coverage: float = 1.0) -> Table:
        """The rows with the ``k`` smallest (largest) values, ties with the last of them too, in no order.

        Missing values are never among them. The cut-off is one value, a scalar
        subquery that filters the scan: the k-th of the column, or with
        ``approximate`` the quantile at k of n rows from a sketch of the given
        ``accuracy``, which lets some more rows through. There ``coverage`` is
        the share of rows the sketch sees; its error then also is that of the
        sample, and the result may hold fewer than ``k`` rows.
        """
        c = F.col(f"`{column}`")
        some = self.df.where(c.isNotNull())
        if approximate:
            seen = some if coverage >= 1 else some.sample(coverage, seed=42)
            n = seen.count()  # a quantile must be a constant
            share = min(1.0, k * (coverage if coverage < 1 else 1.0) / max(n, 1) + 1 / accuracy)
            cut = seen.agg(F.percentile_approx(c, share if ascending else 1 - share, accuracy).alias("__cut"))
        else:
            order = F.col("__v").asc() if ascending else F.col("__v").desc()
            best = some.select(c.alias("__v")).orderBy(order).limit(k)
            cut = best.agg((F.max if ascending else F.min)("__v").alias("__cut"))
        return Table(some.where(c <= cut.scalar() if ascending else c >= cut.scalar()))

    def rank(self, column: str, *, by: tuple[str, ...] = (), ascending: bool = True, name: str = "rank") -> Table:
        """Add the rank of a column within groups."""
        c = F.col(column)
        return Table(self.df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(c.asc() if ascending else c.desc()))))

    # -- partitions -------------------------------------------------------------------

    def partition_by(self, *keys: str, partitions: int | None = None) -> Table:
        """Deal rows by hash of the keys; grouping or joining on them afterwards needs no further exchange."""
        return Table(self.df.repartition(partitions, *keys) if partitions else self.df.repartition(*keys))

    # -- results ----------------------------------------------------------------------

    def evaluate(self) -> DataFrame:
        return self.df

    def rows(self) -> Iterator[Row]:
        """All rows, one partition at a time."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All rows as Arrow batches, one partition at a time."""
        names = self.columns

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["b"])

        for row in self.df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(packed, "b binary").toLocalIterator(prefetchPartitions=True):
            with pa.ipc.open_stream(bytes(row[0])) as stream:
                for b in stream:
                    yield b.rename_columns(names)

    def column_arrays(self, size: int = 10_000) -> Iterator[pa.Array]:
        """A table of one column as arrays of at most ``size`` values."""
        if len(self.columns) != 1:
            raise ValueError("only a table of one column can be read as arrays")
        return (b.column(0).slice(lo, size) for b in self.batches() for lo in range(0, b.num_rows, size))

    def groups(self, key: str, path: str) -> Table:
        """Write one folder for each value of a key below ``path``, and read the table back from there.

        A predicate on the key then reads the folders of the values it asks for.
        """
        spread = self.df.repartition(F.col(key), F.pmod(F.xxhash64(*self.columns), F.lit(16)))  # a common value has up to 16 files
        spread.write.partitionBy(key).parquet(path)
        return Table(self.df.sparkSession.read.schema(self.df.schema).parquet(path).select(*self.columns))

    def n_rows(self) -> int:
        return self.df.count()

    def n_columns(self) -> int:
        return len(self.columns)

    def render(self, mode: str = "formatted") -> str:
        """The plan as text: a mode of Spark's explain, or ``query`` for the tree of operators as written."""
        from quern.plans.render import render

        return render(self.df, mode)


def concatenate(first: Table, *others: Table) -> Table:
    """All rows of all tables, which must agree in names and types."""
    return first.concat(*others)
