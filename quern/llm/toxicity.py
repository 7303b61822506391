"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of longer words, hashed. Each
has a weight and a short vector; the product of two terms' vectors is the weight
of the pair, so an insult may count for more beside another term, which no sum of
single weights can say.

The model is fitted on the driver from a bounded sample of labelled rows
(``sample``). Its terms are counted where the rows are; of those in ``least_rows``
rows or more, ``terms`` (fewer for few rows) are learnt: three quarters by how far their presence tells
the classes apart, the rest by frequency, since a term that tells nothing alone
may do so beside another. Of a row only the learnt terms come to the driver, at
most ``4 * terms`` bytes. Null texts count as empty; empty texts get a score, and
very long texts are read whole. Rows without an id count as held out. Repeated rows and
ids are rows of their own. Without any label to learn from every score is 0.5.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words
from quern.llm.labelled import held_out, training_rows
from quern.llm.scratch import stage

BITS = 22
PREFIXES = (4, 5, 6)
BALANCE = 2.0


def hashed_terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all rows, repeats included, and the row each is of."""
    h, offs, *heads = words.word_hashes(col, PREFIXES)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    terms, rows = [h], [row]
    for head in heads:
        has = head != 0
        terms.append(head[has])
        rows.append(row[has])
    return (np.concatenate(terms) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(rows)


def distinct_terms(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows.astype(np.int64) << BITS | terms)
    return (key & ((1 << BITS) - 1)).astype(np.int32), key >> BITS


@dataclass
class Machine:
    known: np.ndarray  # sorted term numbers
    base: float
    weight: np.ndarray
    vector: np.ndarray

    def margins(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """``term``: places in ``known``, distinct in each row."""
        v = self.vector[term]
        z = np.full(n, self.base) + np.bincount(row, self.weight[term], n)
        for k in range(v.shape[1]):
            z += 0.5 * (np.bincount(row, v[:, k], n) ** 2 - np.bincount(row, v[:, k] ** 2, n))
        return z

    def score(self, col: pa.Array) -> np.ndarray:
        terms, rows = hashed_terms(col)
        if len(self.known):
            at = self.lookup()[terms]
            terms, rows = distinct_terms(at[at >= 0], rows[at >= 0])
        else:
            terms, rows = terms[:0], rows[:0]
        return 1 / (1 + np.exp(-np.clip(self.margins(terms, rows, len(col)), -30, 30)))

    def lookup(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.full(1 << BITS, -1, np.int32)
            self._table[self.known] = np.arange(len(self.known))
        return self._table


def learnable(terms: int, n: int) -> int:
    """At most ``terms``, and one for eight rows: more would be learnt by heart."""
    return min(terms, max(200, n // 8))


def pick_terms(term: np.ndarray, df: np.ndarray, hit: np.ndarray, n: int, p: int, most: int, least_rows: int) -> np.ndarray:
    """Of terms with their numbers of rows and of positive rows (``n`` and ``p`` in all): which to learn."""
    order = np.argsort(term)
    term, d, hit = term[order], df[order].astype(float), hit[order]
    expected = d * p / n
    chi = (hit - expected) ** 2 / np.maximum(expected * (1 - p / n) * (1 - d / n), 1e-9)
    chi = np.where((chi > 3.84) & (d >= least_rows), chi, 0)
    best = np.argsort(-chi, kind="stable")[: most * 3 // 4]
    best = best[chi[best] > 0]
    spread = np.where(d >= least_rows, d * (n - d), 0)
    spread[best] = 0
    common = np.argsort(-spread, kind="stable")[: most // 4]
    return np.sort(term[np.concatenate((best, common[spread[common] > 0]))])


def count_terms(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``term, df, hit`` of rows of distinct terms."""
    every = np.concatenate([np.zeros(0, np.int32), *rows])
    term, inv = np.unique(every, return_inverse=True)
    df, hit = np.bincount(inv, minlength=len(term)), np.bincount(inv, np.repeat(np.asarray(y, float), [len(r) for r in rows]), len(term))
    return term, df, hit.astype(np.int64)


def fit(rows: list[np.ndarray], y: np.ndarray, known: np.ndarray | None = None, *, terms: int = 6000, factors: int = 4, epochs: int = 20, rate: float = 0.01, l2: float = 1e-4, batch: int | None = None, least_rows: int = 4, seed: int = 7) -> Machine:
    """Minimise the logistic loss by Adam over batches of rows in a fixed random order.

    ``rows``: the distinct term numbers of each row, of which ``known`` are learnt
    (None: as :func:`pick_terms` says). Rows of either class weigh by the root of
    how many there are of the other, as far as ``BALANCE``.
    """
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Machine(np.zeros(0, np.int64), base, np.zeros(0), np.zeros((0, factors)))
    if known is None:
        known = pick_terms(*count_terms(rows, y), len(y), int(y.sum()), learnable(terms, len(y)), least_rows)
    batch = batch or int(np.clip(len(y) // 6, 64, 512))
    at = np.full(1 << BITS, -1, np.int32)
    at[known] = np.arange(len(known))
    kept = [k[k >= 0] for k in (at[r] for r in rows)]
    term, offs = np.concatenate(kept), np.concatenate(([0], np.cumsum([len(k) for k in kept])))
    share = y.mean()
    weight = np.where(y > 0, min(BALANCE, max(1.0, np.sqrt((1 - share) / share))), min(BALANCE, max(1.0, np.sqrt(share / (1 - share)))))
    w, v, b = np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)), float(np.log(share / (1 - share)))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    mb = vb = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            size = offs[some + 1] - offs[some]
            r = np.repeat(np.arange(len(some)), size)
            t = term[np.repeat(offs[some] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            tv = v[t]
            total = np.column_stack([np.bincount(r, tv[:, k], len(some)) for k in range(factors)])
            z = b + np.bincount(r, w[t], len(some)) + 0.5 * (total**2 - np.column_stack([np.bincount(r, tv[:, k] ** 2, len(some)) for k in range(factors)])).sum(axis=1)
            g = weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            gt = g[r]
            gw = np.bincount(t, gt, len(w)) + l2 * w
            gv = np.column_stack([np.bincount(t, gt * (total[r, k] - tv[:, k]), len(w)) for k in range(factors)]) + l2 * v
            step += 1
            for value, grad, m, s in ((w, gw, state[0], state[1]), (v, gv, state[2], state[3])):
                m *= 0.9
                m += 0.1 * grad
                s *= 0.999
                s += 0.001 * grad * grad
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            gb = float(g.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Machine(known, b, w, v)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, terms: int = 6000, least_rows: int = 4, **options) -> Machine:
    """Learn ``label`` from at most ``sample`` rows that are not held out."""


    def features(col: pa.Array) -> pa.Array:
        found, row = distinct_terms(*hashed_terms(col))
        ends = np.searchsorted(row, np.arange(len(col) + 1))
        return pa.array([found[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())

    rows = stage(training_rows(docs, labels, label, features, "binary", id_col=id_col, text_col=text_col, sample=sample), "teaching")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                yield [np.frombuffer(x, np.int32) for x in b.column(0).to_pylist()], b.column(1).to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, y in terms_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in count_terms(found, y)], ["term", "df", "hit"])

    sums = rows.mapInArrow(count, "term long, df long, hit long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))
    counts = sums.where(F.col("df") >= least_rows).toArrow()  # at most 2 ** BITS terms of a bounded sample
    known = pick_terms(*(counts.column(c).to_numpy() for c in ("term", "df", "hit")), max(total["n"], 1), total["p"], learnable(terms, total["n"]), least_rows)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, y in terms_of(batches):
            packed = [np.intersect1d(f, shared.value, assume_unique=True).astype(np.int32).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(y.astype(np.int32))], ["x", "y"])

    got = rows.mapInArrow(keep, "x binary, y int").toArrow()
    texts, y = got.column("x").to_pylist(), got.column("y").to_numpy()
    order = sorted(range(len(texts)), key=lambda i: (texts[i], y[i]))  # the order rows arrive in is not fixed
    return fit([np.frombuffer(texts[i], np.int32) for i in order], y[order].astype(float), known, **options)


def score_texts(docs: DataFrame, model: Machine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of terms

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([np.zeros(0)] + [shared.value.score(b.column(2).slice(lo, 512)) for lo in range(0, b.num_rows, 512)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    return picked.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
