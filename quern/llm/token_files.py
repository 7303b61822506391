"""Token ids as Parquet list columns in ascending document order.

Files hold one row a document: ``doc_id``, ``part`` and ``local_start`` (ids
before it in its part), ``n_tokens`` and the list ``ids``. Ids are dictionary
encoded, with delta packing where a dictionary grows too large; row groups and
pages have set sizes and every file carries a page index, so metadata can be
read without touching ids and a range of documents without reading the rest.

Null texts count as empty; a very long text is one row, however many ids it has.
Repeated ids and rows all stay, in the order of id,
then of the text's hash. Null ids come first. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.tokens import encoder

#: Parts up to which their first places are broadcast (16 bytes each); beyond, they are joined by merge.
PARTS = 1 << 20
FILES = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 1, row_group_bytes: int = 32 << 20, page_rows: int = 1000
) -> None:
    """Encode ``docs`` (doc_id, text) and write the files to ``path``.

    Texts are dealt by range of document id before they are encoded, so that
    each is encoded once and the ids are never shuffled. The text's hash and a
    row number are part of the range, so one id, or one row, that recurs often
    fills many parts.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                packed = [p + end for p in enc.packed_all(b.column(1).to_pylist())]
                n = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
                ends = np.cumsum(n)
                ids = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), ids)
                cols = [b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += int(ends[-1]) if len(ends) else 0

    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n")).repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h")
    (
        dealt.select("doc_id", "text")
        .mapInArrow(encode, FILES)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files as ``doc_id, start, n_tokens, ids``; select fewer columns to read fewer.

    ``start`` counts the ids of all documents before. It needs the total of
    each part, taken from two metadata columns: one row a part.
    """
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part, in one task
    first = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    parts = len(files.inputFiles())
    first = F.broadcast(first) if parts <= PARTS else first.hint("merge")
    return files.join(first, "part").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the ids that were read back."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            o = ids.offsets.to_numpy()
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(raw[a:z]) for a, z in zip(o[:-1], o[1:])]
            cols = [b.column(0), b.column(1), pa.array(np.diff(o).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
