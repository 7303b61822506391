"""Places of texts near which a known word n-gram occurs.

The known n-grams pass to the workers as a bit filter of fixed size, whatever
their number; what it lets through is settled by an exact join afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words

FILTER_BITS = 25
_SHIFT = np.uint64(64 - FILTER_BITS)


def filter_of(hashes: np.ndarray) -> np.ndarray:
    """A filter of given n-gram hashes: one bit for each value of their leading bits."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[hashes.view(np.uint64) >> _SHIFT] = True
    return np.packbits(bits, bitorder="little")


def filter_of_table(grams: DataFrame, col: str) -> np.ndarray:
    """The same of a column; at most ``2 ** (FILTER_BITS - 6)`` rows reach the driver."""
    lead = F.shiftrightunsigned(F.col(col), 64 - FILTER_BITS)
    cells = grams.select(F.shiftright(lead, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.astype("<i8").view(np.uint8)


def passes(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    lead = (grams >> _SHIFT).astype(np.int64)
    return (known[lead >> 3] >> (lead & 7).astype(np.uint8)) & 1 > 0


def regions_of(h: np.ndarray, offs: np.ndarray, n: int, known: np.ndarray, pad: int, shorter: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, first word, words, places, n-grams)`` of each stretch with passing n-grams (or ``shorter`` ones), ``pad`` words around."""
    grams, at = words.own_ngrams(h, offs, n)
    if shorter:
        every = [(grams, at), *(words.own_ngrams(h, offs, m) for m in shorter)]
        grams, at = (np.concatenate(x) for x in zip(*every))
        order = np.argsort(at, kind="stable")
        grams, at = grams[order], at[order]
    hit = np.flatnonzero(passes(known, grams))
    if not len(hit):
        return
    grams, at = grams[hit], at[hit]
    row = np.searchsorted(offs, at, side="right") - 1
    lo, hi = np.maximum(at - pad, offs[row]), np.minimum(at + n + pad, offs[row + 1])
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1]))))
    for a, z in zip(cut, np.concatenate((cut[1:], [len(at)]))):
        r, s, e = int(row[a]), int(lo[a]), int(hi[z - 1])
        yield r, s - int(offs[r]), h[s:e], at[a:z] - s, grams[a:z]


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    flat = flat.view(np.int64) if flat.dtype == np.uint64 else flat
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


class Numbering:
    """Row numbers that differ between tasks; stable once written."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 40

    def take(self, n: int) -> np.ndarray:
        self.next += n
        return np.arange(self.next - n, self.next)


def find_regions(docs: DataFrame, id_col: str, text_col: str, n: int, known: np.ndarray, pad: int, *, shorter: tuple[int, ...] = (), kind: str = "long") -> DataFrame:
    """``rid, doc_id, start, words, at, gram`` of each such stretch of ``docs``; stage it before use. ``kind``: the type of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbering()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                got = list(regions_of(*words.word_hashes(b.column(1)), n, shared.value, pad, shorter))
                if got:
                    row, start, w, at, g = zip(*got)
                    cols = [pa.array(number.take(len(got))), b.column(0).take(pa.array(row)), pa.array(start, pa.int64()), lists(w, pa.int64()), lists(at, pa.int32()), lists(g, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "start", "words", "at", "gram"])

    return docs.select(F.col(id_col).cast(kind).alias("doc_id"), text_col).mapInArrow(
        scan, f"rid long, doc_id {kind}, start long, words array<long>, at array<int>, gram array<long>"
    )
