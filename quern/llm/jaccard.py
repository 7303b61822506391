"""Self-join of texts on the Jaccard similarity of their word n-grams.

1. Texts that are equal fall together; the rest works on distinct texts.
2. MinHash bands propose candidates. Texts that share a band are tied to the
   least of them (a star, not all pairs), and the stars' components say which
   texts must meet.
3. A component is compared in one task, or, where it is large, in tasks over
   pairs of its blocks, which are bounded in texts and in shingles. There MinHash values are compared a few at a time, and a
   pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold is below ``tolerance`` (uniform prior, binomial
   matches). Pairs that stay are verified exactly. Tasks emit a link count and a
   root for each text, never the pairs.

The work on a component grows with the square of its texts, as every link is
counted; a very long text is one row like others. A text of fewer than n words has one shingle, all of its words; a text without
words is similar to equal texts only. Null texts count as empty. Repeated rows
and ids are rows of their own; the class id is the least non-null id of the
class. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words
from quern.llm.components import components
from quern.llm.scratch import drop, stage

U64 = np.uint64
BANDS, ROWS, STEP = 28, 5, 20
HASHES = BANDS * ROWS
_MUL = np.random.default_rng(11).integers(1, 1 << 63, HASHES, dtype=U64) * U64(2) + U64(1)
#: Shingles that are hashed at once, about.
SLICE = 1 << 16
#: Shingles of a block of texts, about, and the most bytes of bits over them.
SHINGLES, BITS = 1 << 21, 1 << 26
#: A group of texts is dealt over blocks of at least so many texts, if it has them, so that one group is many tasks.
LEAST, SPREAD = 256, 12


def shingle_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each row, sorted, and their n + 1 offsets."""
    h, offs = words.word_hashes(col)
    grams, at = words.own_ngrams(h, offs, n)
    ends = np.searchsorted(at, offs)
    sets = []
    for i in range(len(offs) - 1):
        if ends[i] < ends[i + 1]:
            sets.append(np.unique(grams[ends[i] : ends[i + 1]]))
        elif offs[i] < offs[i + 1]:
            sets.append(words.ngrams(h[offs[i] : offs[i + 1]], int(offs[i + 1] - offs[i])))
        else:
            sets.append(np.zeros(0, U64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash values of each row; a row without shingles gets the largest value throughout."""
    n = len(offs) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, side="right")) - 1)
        rows = np.flatnonzero(offs[lo + 1 : hi + 1] > offs[lo:hi]) + lo
        if len(rows):
            x, starts = sets[offs[lo] : offs[hi]], offs[rows] - offs[lo]
            for k in range(HASHES):
                out[rows, k] = np.minimum.reduceat(x * _MUL[k], starts) >> U64(32)
        lo = hi
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), U64)
    for b in range(BANDS):
        k = np.full(len(sig), b + 1, U64)
        for c in range(b * ROWS, (b + 1) * ROWS):
            k = words.mix(k * U64(0x9E3779B97F4A7C15) + sig[:, c])
        keys[:, b] = k
    return keys


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For 0..HASHES compared values: the fewest matches with which a pair stays a candidate."""
    s = (np.arange(2000) + 0.5) / 2000
    above, out = s >= threshold, np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        tail = p[:, above].sum(axis=1) / p.sum(axis=1)
        out[n] = int(np.argmax(tail >= tolerance))
    return out


class Shared:
    """Counts of shingles that one of several sets shares with others, in bounded memory.

    Where the shingles that at least two sets have are few, each set is a row of
    bits over them; else a set's shingles are marked in a row of their own and
    looked up for the others. ``most`` bytes are the limit of the bits.
    """

    def __init__(self, sets: list[np.ndarray], most: int = BITS):
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        vals, inv, n = np.unique(np.concatenate([np.zeros(0, U64), *sets]), return_inverse=True, return_counts=True)
        col, keep = np.cumsum(n > 1) - 1, n[inv] > 1
        self.width = int((n > 1).sum())
        row, self.cols = np.repeat(np.arange(len(sets)), size)[keep], col[inv[keep]].astype(np.int32)
        self.offs = np.searchsorted(row, np.arange(len(sets) + 1))
        words_ = max(1, math.ceil(self.width / 64))
        self.bits = None
        if words_ * 8 * len(sets) <= most:
            self.bits = np.zeros((len(sets), words_), U64)
            np.bitwise_or.at(self.bits, (row, self.cols >> 6), U64(1) << (self.cols & 63).astype(U64))
        else:
            self.mark = np.zeros(self.width, bool)

    def counts(self, i: int, js: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[js] & self.bits[i]).sum(axis=1).astype(np.int64)
        mine = self.cols[self.offs[i] : self.offs[i + 1]]
        self.mark[mine] = True
        out = np.fromiter((np.count_nonzero(self.mark[self.cols[self.offs[j] : self.offs[j + 1]]]) for j in js), np.int64, len(js))
        self.mark[mine] = False
        return out


def compare(sig: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (weighted) and its root among these rows; ``right`` None: all pairs within ``left``."""
    n = len(sets)
    links, root = np.zeros(n, np.int64), np.arange(n)
    size = np.fromiter(map(len, sets), np.int64, n)
    shared: Shared | None = None

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for p, i in enumerate(left):
        if not size[i]:
            continue
        js = left[p + 1 :] if right is None else right
        small, large = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
        js = js[(small >= threshold * large - 1e-9) & (small > 0)]
        got = np.zeros(len(js), np.int64)
        for a in range(0, HASHES, STEP):
            if not len(js):
                break
            got = got + (sig[js, a : a + STEP] == sig[i, a : a + STEP]).sum(axis=1)
            stay = got >= least[min(a + STEP, HASHES)]
            js, got = js[stay], got[stay]
        if not len(js):
            continue
        if len(js) < 8 and shared is None:
            both = np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in js), np.int64, len(js))
        else:
            if shared is None:
                shared = Shared(sets)
            both = shared.counts(int(i), js)
        js = js[both >= threshold * (size[i] + size[js] - both) - 1e-9]
        if len(js):
            links[i] += weight[js].sum()
            links[js] += weight[i]
            tops = {top(int(i))} | {top(int(j)) for j in js}
            low = min(tops)
            root[list(tops)] = low
    return links, np.fromiter((top(i) for i in range(n)), np.int64, n)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("k"), text.alias("text"))


def text_classes(keyed: DataFrame, *, n: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """One row a distinct text: ``k, class_id, n_links, head``; ``head`` marks one text of a class."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                sets, offs = shingle_sets(b.column(1), n)
                keys = band_keys(signatures(sets, offs)).view(np.int64)
                keys = keys[offs[1:] > offs[:-1]]
                has = pa.array(offs[1:] > offs[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(has), pa.array(np.diff(offs)).filter(has), lists], ["k", "size", "bands"])

    rows = keyed.select("doc_id", "k").groupBy("k").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    texts = stage(rows, "texts")  # one row a distinct text: its key, least id and number of copies
    banded = keyed.select("k", "text").mapInArrow(propose, "k binary, size long, bands array<long>")
    signed = stage(banded.groupBy("k").agg(F.first("size").alias("size"), F.first("bands").alias("bands")), "bands")
    banded = signed.select("k", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("k").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub")
    meet = components(banded.join(stars, "band").where("k != hub").select(F.col("k").alias("a"), F.col("hub").alias("b")))

    meet = stage(meet.withColumnRenamed("node", "k").join(signed.select("k", "size"), "k"), "meet")
    n_texts = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(n_texts / block), F.ceil(F.sum("size") / SHINGLES), F.least(F.ceil(n_texts / LEAST), F.lit(SPREAD)))
    sized = meet.groupBy("root").agg(blocks.cast("int").alias("blocks"))
    work = meet.drop("size").join(sized, "root").join(texts.select("k", "n"), "k")
    bodies = keyed.select("k", "text").groupBy("k").agg(F.first("text").alias("text"))
    least = least_matches(threshold, tolerance)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                sets, offs = shingle_sets(b.column(4), n)
                sig = signatures(sets, offs)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:4], pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([sets[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:])], pa.binary())],
                    ["k", "n", "root", "blocks", "sig", "sets"],
                )

    sketched = work.join(bodies, "k").select("k", "n", "root", "blocks", "text").mapInArrow(sketch, "k binary, n long, root binary, blocks int, sig binary, sets binary")
    own = F.pmod(F.xxhash64("k"), F.col("blocks").cast("long")).cast("int")
    dealt = sketched.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
    # pairs of blocks of one group go to tasks in turn, so that they don't meet by chance
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.col("j").cast("long") * (F.col("j") + 1) / 2 + F.col("i")
    task = F.pmod(F.pmod(F.xxhash64("root"), F.lit(tasks)) + turn.cast("long"), F.lit(tasks)).cast("int")
    ordered = dealt.repartitionById(tasks, task).sortWithinPartitions("root", "i", "j", "k")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            sig = np.frombuffer(b"".join(r[2] for r in held), np.uint32).reshape(len(held), HASHES)
            sets = [np.frombuffer(r[3], U64) for r in held]
            weight, side = np.array([r[1] for r in held], np.int64), np.array([r[4] for r in held])
            if key[1] == key[2]:
                links, root = compare(sig, sets, weight, np.arange(len(held)), None, threshold, least)
            else:
                links, root = compare(sig, sets, weight, np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2]), threshold, least)
            at = np.flatnonzero(links)
            ks = [r[0] for r in held]
            return pa.RecordBatch.from_arrays([pa.array([ks[x] for x in at], pa.binary()), pa.array([ks[root[x]] for x in at], pa.binary()), pa.array(links[at])], ["a", "b", "links"])

        for batch in batches:
            for k, w, r, sig, sets, side, i, j in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (r, i, j):
                    if (out := done()) is not None:
                        yield out
                    held, key = [], (r, i, j)
                held.append((k, w, sig, sets, side))
        if (out := done()) is not None:
            yield out

    found = stage(ordered.select("k", "n", "root", "sig", "sets", "own", "i", "j").mapInArrow(verify, "a binary, b binary, links long"), "links")
    # a text has a root in every pair of blocks it was in: it is tied to the least, and so are the others
    linked = found.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"), F.array_sort(F.collect_set("b")).alias("roots"))
    hub = F.col("roots")[0]
    more = linked.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), hub.alias("b")).where("a != b").distinct()
    classes = components(linked.select(F.col("k").alias("a"), hub.alias("b")).union(more))
    linked = linked.drop("roots")
    per_text = texts.join(classes.withColumnRenamed("node", "k"), "k", "left").join(linked, "k", "left").withColumn("root", F.coalesce("root", "k"))
    heads = per_text.groupBy("root").agg(F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull(), "low", "k")).alias("head"))
    links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long")
    return per_text.join(heads, "root").select("k", "class_id", links.alias("n_links"), (F.col("k") == F.col("head.k")).alias("head"))


def jaccard_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, block: int = 8192
) -> DataFrame:
    """One row a document: ``doc_id, class_id, n_links``.

    ``n_links`` counts the other rows with similarity at or over ``threshold``,
    equal texts included. ``class_id`` is the least id of those connected by
    links, directly or through others.
    """
    keyed = _keyed(docs, id_col, text_col)
    per_text = text_classes(keyed, n=n, threshold=threshold, tolerance=tolerance, block=block)
    return keyed.select("doc_id", "k").join(per_text, "k").select("doc_id", "class_id", "n_links")


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, block: int = 8192
) -> DataFrame:
    """The rows of ``docs``, one for each class: that of the least id.

    Of equal texts with equal ids the row that stays is chosen by a hash of its
    other columns. Equal texts are combined before the shuffle, so a text that
    many rows have costs one row a task. All columns are carried through.
    """
    per_text = text_classes(_keyed(docs, id_col, text_col), n=n, threshold=threshold, tolerance=tolerance, block=block)
    keys = per_text.where("head").select(F.col("k").alias("__k"))
    others = F.to_json(F.struct(F.lit(0).alias("0"), *(F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col))))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(others), F.col(text_col).isNull())
    one = docs.groupBy(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("__k")).agg(F.min_by(row, order).alias("__row"))
    return one.join(keys, "__k", "left_semi").select("__row.*")
