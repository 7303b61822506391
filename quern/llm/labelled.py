"""Shared parts of the two classifiers: which rows teach, and a bounded sample of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves 0 by 5 never teach; neither do rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, features: Callable[[pa.Array], pa.Array], kind: str, *, id_col: str, text_col: str, sample: int
) -> DataFrame:
    """``x, y`` of at most ``sample`` labelled rows that may teach, chosen by the hash of their id.

    ``features`` makes ``x``, of type ``kind``, from texts where they are read.
    The chosen labels are bounded by ``sample``, so they are broadcast. Of rows
    that share an id the one whose text has the least hash teaches.
    """
    own = labels.where(~held_out(id_col) & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    one = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(own), "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), features(b.column(2)), b.column(3)], ["id", "h", "x", "y"])

    id_kind = one.schema["id"].dataType.simpleString()
    rows = one.select("id", F.xxhash64("text").alias("h"), "text", "y").mapInArrow(scan, f"id {id_kind}, h long, x {kind}, y int")
    return rows.groupBy("id").agg(F.min_by("x", "h").alias("x"), F.max("y").alias("y")).select("x", "y")
