"""Rows of the driver's program, in and out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.operators.table import Table


def import_rows(spark: SparkSession, rows: Iterable[tuple], schema: str, *, batch: int = 100_000) -> Table:
    """A finite stream of tuples as a table; it is read to its end before this returns.

    Batches become Arrow tables and DataFrames of their own, so no list holds them
    all at once on the Python side. A datetime without zone is one of UTC.
    """
    kinds = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)
    source, parts = iter(rows), []
    while some := list(islice(source, batch)):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)]
        parts.append(spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kinds))
    df = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        df = df.unionAll(p)
    return Table.of(df)


def export_rows(table: Table) -> Iterator[tuple]:
    """All rows as tuples, one partition in memory at a time."""
    return (tuple(r) for r in table.rows())
