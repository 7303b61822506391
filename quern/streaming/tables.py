"""Select lists over streams, and streams into tables.

The language itself is for finite tables; this module carries its row operators
over to a stream and lands a stream in a folder that tables are made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.operators.select import Select
from quern.operators.table import Table


def query_stream(stream: DataFrame, program: Select) -> DataFrame:
    """Filter and project each row of a stream."""
    return Table(stream).query(program).df


def reduce_windows(stream: DataFrame, time_col: str, late: str, width: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates by key and window of event time; rows later than ``late`` are left out."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(*aggregates)


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived, each row once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
