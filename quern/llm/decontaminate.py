"""Texts that hold passages of benchmark items, exact, edited or paraphrased.

Word n-grams of the items are looked for in every whole text; a text that has
any of an item's n-grams becomes a candidate for that item. None is left out as
frequent: the copies looked for raise the frequency of what they keep. Candidates
are scored by Smith-Waterman alignment of words around the shared seeds: the
score over that of a perfect copy.

Null texts count as empty, and so do null items; very long texts are searched
whole. An item of fewer words than a seed is its own seed, so it is found where
all its words stand; one of a single word, or none, holds no passage and is never
found. Of places with equal scores the first counts. Repeated rows give one
result for each pair of ids, rows without an id are one id; equal items each
have their own. Empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import seeds, words
from quern.llm.align import MATCH, local_scores
from quern.llm.scratch import stage


def item_words(items: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``item_id, words, gram``: the word hashes of each item and the hashes of its n-grams by place."""

    def grams(x: np.ndarray) -> np.ndarray:
        return words.ngrams(x, n) if len(x) >= n or len(x) < 2 else words.ngrams(x, len(x))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, offs = words.word_hashes(b.column(1))
            w = [h[a:z] for a, z in zip(offs[:-1], offs[1:])]
            cols = [b.column(0), seeds.lists(w, pa.int64()), seeds.lists([grams(x) for x in w], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "words", "gram"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), text_col).mapInArrow(cut, "item_id long, words array<long>, gram array<long>")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 4,
    threshold: float = 0.5,
    id_kind: str = "long",
) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word`` of every pair that scores ``threshold`` or more; ``doc_id`` has type ``id_kind``."""
    known = stage(item_words(items, item_id_col, item_text_col, n), "items")
    grams = known.select("item_id", F.posexplode("gram").alias("place", "gram"))
    longest = known.agg(F.max(F.size("words"))).first()[0] or 0
    shorter = tuple(sorted(r[0] for r in known.select(F.size("words")).where(F.size("words").between(2, n - 1)).distinct().collect()))  # fewer than n
    regions = stage(seeds.find_regions(docs, id_col, text_col, n, seeds.filter_of_table(grams, "gram"), longest + longest // 4, shorter=shorter, kind=id_kind), "regions")
    hits = regions.select("rid", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("rid", "x.at", "x.gram")
    found = hits.join(grams, "gram").groupBy("rid", "item_id").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    pairs = found.join(regions.select("rid", "doc_id", "start", F.col("words").alias("text_words")), "rid").join(known.select("item_id", "words").distinct(), "item_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                doc, item, start = b.column(0), *(b.column(k).to_pylist() for k in (1, 2))
                (dv, do), (tv, to), (iv, io) = (_lists(b.column(k)) for k in (3, 4, 5))
                owner, base, work = [], [], []
                for r in range(len(doc)):
                    text, known_words = tv[to[r] : to[r + 1]].view(np.uint64), iv[io[r] : io[r + 1]].view(np.uint64)
                    slack = len(known_words) // 4 + 4
                    d = np.sort(dv[do[r] : do[r + 1]])
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(d) > len(known_words) + 2 * slack)))
                    for a, z in zip(cut, np.concatenate((cut[1:], [len(d)]))):
                        s, e = max(0, int(d[a]) - slack), int(d[z - 1]) + len(known_words) + slack
                        owner.append(r)
                        base.append(start[r] + s)
                        work.append((known_words, text[s:e]))
                got, first, end = local_scores(work)
                share = got / np.array([MATCH * len(w[0]) for w in work], float)
                at = np.flatnonzero(share >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array([owner[x] for x in at], pa.int64())), pa.array([item[owner[x]] for x in at], pa.int64()), pa.array(share[at]), pa.array([base[x] + int(first[x]) for x in at], pa.int64()), pa.array([base[x] + int(end[x]) for x in at], pa.int64())],
                    ["doc_id", "item_id", "score", "first_word", "end_word"],
                )

    scored = pairs.select("doc_id", "item_id", "start", "diagonals", "text_words", "words").mapInArrow(score, f"doc_id {id_kind}, item_id long, score double, first_word long, end_word long")
    best = F.struct("score", -F.col("first_word"), "end_word")
    return scored.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "first_word", "end_word"), best).alias("x")).select("doc_id", "item_id", "x.*")


def _lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    o = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False).astype(np.int64), o


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is in no contaminated pair.

    Texts stand for rows here, by their hash, so rows without an id or with a
    repeated one are judged each by its own text.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    bad = contaminated(docs.select(key.alias("__text"), text_col), items, id_col="__text", text_col=text_col, id_kind="binary", **options)
    return docs.withColumn("__text", key).join(bad.select(F.col("doc_id").alias("__text")).distinct(), "__text", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
