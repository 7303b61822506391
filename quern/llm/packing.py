"""Vector best-fit packing of token pieces into sequences.

Every sequence has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces are placed in order of falling length,
each into the open sequence that scores best among those with room in all
three; a new one opens only when none has.

A piece's demand follows from its length alone, so the plan needs no more than
the count of pieces of each length: at most ``capacity`` numbers, whatever the
corpus. Sequences in like state are kept as one range of sequence numbers, and
pieces of one length fill such a range at once. The plan is a list of runs,
found by (length, rank of the piece among those of its length); ranks come from
counts per part, so no task sees all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import stage
from quern.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def tokenize_pieces(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of each document (ids, then ``end_id``), cut only where longer than ``capacity``.

    ``part`` and ``nth`` number the pieces of one length within a task.
    ``with_ids`` adds the ids themselves. Null texts count as empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        nth = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                rows: list[tuple] = []
                for doc, packed in zip(b.column(0).to_pylist(), enc.packed_all(b.column(1).to_pylist())):
                    packed += end
                    total = len(packed) // 4
                    for k, at in enumerate(range(0, total, capacity)):
                        raw, n = packed[4 * at : 4 * (at + capacity)], min(capacity, total - at)
                        rows.append((doc, k, at, n, zlib.crc32(raw), part, int(nth[n]), *([np.frombuffer(raw, "<u4").astype(np.int32)] if with_ids else [])))
                        nth[n] += 1
                cols = list(zip(*rows)) or [[]] * (7 + with_ids)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names[: 7 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def plan(
    counts: dict[int, int],
    *,
    capacity: int,
    max_documents: int,
    max_cost: int,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    score: str = "norm",
) -> tuple[np.ndarray, int]:
    """Runs ``(length, first rank, first sequence, pieces a sequence, offset)`` and the number of sequences.

    ``score``: ``norm`` prefers the least weighted norm of what is left after
    the piece, ``dot`` the greatest weighted dot product of piece and room.
    """
    caps, w = np.array([capacity, max_documents, max_cost], float), np.array(weights)
    room = np.zeros((64, 3))  # of each range of like sequences
    first, count, used = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    runs, sequences = [], 0

    def put(seq: int, n: int, left: np.ndarray) -> None:
        nonlocal room, first, count, used
        if used == len(first):
            room, first, count = np.concatenate((room, room * 0)), np.concatenate((first, first * 0)), np.concatenate((count, count * 0))
        room[used], first[used], count[used] = left, seq, n
        used += 1

    for length in sorted(counts, reverse=True):
        need, todo, rank = np.array([length, 1.0, float(length) ** 2]), counts[length], 0
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        fits = np.flatnonzero((room[:used] >= need).all(axis=1) & (count[:used] > 0))
        if len(fits):
            left = (room[fits] - need) / caps
            worth = (w * left**2).sum(axis=1) if score == "norm" else -(w * (need / caps) * (room[fits] / caps)).sum(axis=1)
            fits = fits[np.lexsort((first[fits], worth))]
        for k in fits:
            if not todo:
                break
            q = int((room[k] // need).min())
            seq, n = int(first[k]), int(count[k])
            full = min(n, todo // q)
            if full:
                runs.append((length, rank, seq, q, int(capacity - room[k, 0])))
                rank, todo = rank + full * q, todo - full * q
            part = todo if full < n else 0  # fewer than q
            if part:
                runs.append((length, rank, seq + full, part, int(capacity - room[k, 0])))
                rank, todo = rank + part, 0
            was, touched = room[k].copy(), full + bool(part)
            if touched < n:
                first[k], count[k] = seq + touched, n - touched
            else:
                count[k] = 0
            if full:
                put(seq, full, was - q * need)
            if part:
                put(seq + full, 1, was - part * need)
        if todo:
            q = int((caps // need).min())
            full, part = divmod(todo, q)
            if full:
                runs.append((length, rank, sequences, q, 0))
                put(sequences, full, caps - q * need)
            if part:
                runs.append((length, rank + full * q, sequences + full, part, 0))
                put(sequences + full, 1, caps - part * need)
            sequences += full + bool(part)
        keep = np.flatnonzero((count[:used] > 0) & (room[:used] > 0).all(axis=1))
        room[: len(keep)], first[: len(keep)], count[: len(keep)], used = room[keep], first[keep], count[keep], len(keep)
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, max_documents: int | None = None, max_cost: int | None = None, score: str = "norm") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``length``, ``part`` and ``nth``.

    ``pieces`` is read twice, so it should be staged. Capacities left out don't
    bind. Columns other than the three used are carried through.
    """
    tally = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    tally = stage(tally, "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity=capacity, max_documents=max_documents or capacity, max_cost=max_cost or capacity**2, score=score)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = tally.select("length", "part", before.alias("rank"))
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # its size depends on `capacity`, not on the corpus
    names = pieces.columns
    spec = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for b in batches:
            n = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, n << 44 | rank, side="right") - 1
            r = runs[k] if len(n) else np.zeros((0, 5), np.int64)
            seq, nth = np.divmod(rank - r[:, 1], np.maximum(r[:, 3], 1))
            cols = [*b.columns[: len(names)], pa.array(r[:, 2] + seq), pa.array(r[:, 4] + nth * n)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    ranked = pieces.join(ranks.hint("merge"), ["length", "part"]).select(*names, (F.col("rank") + F.col("nth")).alias("__rank"))
    return ranked.mapInArrow(place, spec)


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack documents: one row a piece with its sequence and its place there.

    Null texts count as empty, and an empty text is its end id alone. Repeated
    rows and ids are packed each for itself. An empty table gives no rows.
    """
    pieces = stage(tokenize_pieces(docs, vocabulary, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity=capacity, **options).drop("part", "nth")
