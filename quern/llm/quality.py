"""Text quality by a generalised additive model with pairwise interactions.

Measures of a text (length, case, symbols, repetition and the like) are cut into
bins. Shallow trees are boosted round the features in turn, each on one feature
only, so that the model is a lookup table for every feature; then the most useful
pairs get tables of their own in the same way. A score is the sum of the bins'
entries, read for whole batches at once.

The model is fitted on the driver from a bounded sample of labelled rows
(``sample``). Null texts count as empty; empty texts get a score. Rows without
an id count as held out. Repeated rows and ids are rows of their own. Without
any label to learn from every score is 0.5. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words
from quern.llm.labelled import held_out, training_rows

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "repeated_marks", "bars", "blanks", "lines",
    "wide", "distinct_words", "distinct_pairs", "top_word", "stops", "capitals_after_blank",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARK, _SYMBOL = _class(b".,;:!?'\"()-"), _class(b"#$%&*+/<=>@[\\]^_`{}~|!")
_BAR, _BLANK, _LINE, _STOP = _class(b"|"), _class(b" \t"), _class(b"\n"), _class(b".")
ROWS = 1 << 10
_WIDE = np.concatenate((np.zeros(128, np.int64), np.ones(128, np.int64)))
_CLASSES = np.column_stack([_UPPER, _DIGIT, _MARK, _SYMBOL, _BAR, _BLANK, _LINE, _WIDE, _STOP, words.IS_WORD.astype(np.int64)])


def repeats(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` rows how many different values it has and how often the commonest; ``row`` rises."""
    kinds, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lo in range(0, n, ROWS):  # a key holds the row in 10 bits and 54 bits of the hash
        a, z = np.searchsorted(row, (lo, lo + ROWS))
        key = np.sort((row[a:z] - lo).astype(np.uint64) << np.uint64(54) | values[a:z] >> np.uint64(10))
        if len(key):
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            of = (key[start] >> np.uint64(54)).astype(np.int64) + lo
            kinds += np.bincount(of, minlength=n)
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            most[of[first]] = np.maximum.reduceat(np.diff(np.concatenate((start, [len(key)]))), first)
    return kinds, most


def measure(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offs = words.text_bytes(col)
    h, woffs = words.word_hashes(col)
    n = len(offs) - 1
    size, count = np.diff(offs).astype(float), np.diff(woffs).astype(float)

    row = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(row << 8 | data, minlength=n << 8).reshape(n, 256)
    upper, digit, mark, symbol, bar, blank, line, wide, stop, letter = (counts @ _CLASSES).T / np.maximum(size, 1)
    before = np.concatenate(([32], data[:-1])) if len(data) else data
    before[offs[:-1][size > 0]] = 32  # no text depends on the one before

    def share(where: np.ndarray) -> np.ndarray:
        return np.bincount(row[np.flatnonzero(where)], minlength=n) / np.maximum(size, 1)

    again = share((data == before) & (_SYMBOL[data] > 0))
    capitals = share((_UPPER[data] > 0) & (_BLANK[before] > 0))
    kinds, most = repeats(h, np.repeat(np.arange(n), np.diff(woffs)), n)
    distinct, top = np.where(count > 0, kinds / np.maximum(count, 1), 1), most / np.maximum(count, 1)
    two, at = words.own_ngrams(h, woffs, 2)
    kinds, _ = repeats(two, np.searchsorted(woffs, at, side="right") - 1, n)
    pairs = np.where(count > 1, kinds / np.maximum(count - 1, 1), 1)
    columns = [
        np.log1p(size), np.log1p(count), letter * size / np.maximum(count, 1), upper, digit, mark, symbol, again, bar, blank, line, wide,
        distinct, pairs, top, stop, capitals,
    ]
    return np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Gam:
    """Bin edges and lookup tables; ``pairs`` are of feature numbers, their tables by both bins."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _steps(grad: np.ndarray, hess: np.ndarray, leaves: int, l2: float) -> tuple[np.ndarray, float]:
    """A tree on one ordered feature: values by bin, and its gain."""
    worth = lambda g, h: g * g / (h + l2)
    parts, total = [(0, len(grad))], 0.0
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, z) in enumerate(parts):
            cut = np.arange(a + 1, z)
            if len(cut):
                gain = worth(g[cut] - g[a], h[cut] - h[a]) + worth(g[z] - g[cut], h[z] - h[cut]) - worth(g[z] - g[a], h[z] - h[a])
                c = int(np.argmax(gain))
                if gain[c] > best[0]:
                    best = (gain[c], k, int(cut[c]))
        if best[1] is None:
            break
        a, z = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], z)]
        total += best[0]
    out = np.zeros(len(grad))
    for a, z in parts:
        out[a:z] = (g[z] - g[a]) / (h[z] - h[a] + l2)
    return out, total


def _quarters(grad: np.ndarray, hess: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """A tree with one cut of either of two features: values by both bins, and its gain."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    worth = lambda a, b: a * a / (b + l2)
    lo_g, lo_h = g[1:-1, 1:-1], h[1:-1, 1:-1]
    quads = [(lo_g, lo_h), (g[1:-1, -1:] - lo_g, h[1:-1, -1:] - lo_h), (g[-1:, 1:-1] - lo_g, h[-1:, 1:-1] - lo_h)]
    quads.append((g[-1, -1] - sum(q[0] for q in quads), h[-1, -1] - sum(q[1] for q in quads)))
    out = np.zeros(grad.shape)
    if not lo_g.size:
        return out, 0.0
    gain = sum(worth(*q) for q in quads) - worth(g[-1, -1], h[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [q[0][i, j] / (q[1][i, j] + l2) for q in quads]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3, l2: float = 1.0) -> Gam:
    """Cyclic boosting of the features, then of the pairs with the largest gain on what is left."""
    nf = len(FEATURES)
    if not len(y):
        return Gam([np.zeros(0)] * nf, 0.0, [np.zeros(1)] * nf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(nf)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    b, z = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            g, h = slopes()
            step, _ = _steps(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)), leaves, l2)
            t += rate * step
            z += rate * step[b[:, f]]

    def grid(f: int, k: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(edges[f]) + 1, len(edges[k]) + 1)
        return b[:, f] * shape[1] + b[:, k], shape

    g, h = slopes()
    ranked = []
    for f in range(nf):
        for k in range(f + 1, nf):
            at, shape = grid(f, k)
            size = shape[0] * shape[1]
            ranked.append((-_quarters(np.bincount(at, g, size).reshape(shape), np.bincount(at, h, size).reshape(shape), l2)[1], f, k))
    model.pairs = [(f, k) for _, f, k in sorted(ranked)[:pairs]]
    model.pair_tables = [np.zeros(grid(f, k)[1]) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for (f, k), t in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            at, shape = grid(f, k)
            step, _ = _quarters(np.bincount(at, g, t.size).reshape(shape), np.bincount(at, h, t.size).reshape(shape), l2)
            t += rate * step
            z += rate * step.ravel()[at]
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, **options) -> Gam:
    """Learn ``label`` from at most ``sample`` rows that are not held out."""

    def features(col: pa.Array) -> pa.Array:
        return pa.array(list(measure(col)), pa.list_(pa.float64()))

    rows: pd.DataFrame = training_rows(docs, labels, label, features, "array<double>", id_col=id_col, text_col=text_col, sample=sample).toPandas()
    order = sorted(range(len(rows)), key=lambda i: (*rows.x[i], rows.y[i]))  # the order rows arrive in is not fixed
    x = np.array([rows.x[i] for i in order], float).reshape(-1, len(FEATURES))
    return fit(x, rows.y.to_numpy()[order].astype(float), **options)


def score_texts(docs: DataFrame, model: Gam, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([np.zeros(0)] + [shared.value.score(measure(b.column(2).slice(lo, 512))) for lo in range(0, b.num_rows, 512)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_col)
    return picked.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                yield b.filter(pa.array(shared.value.score(measure(b.column(at))) >= threshold))

    return docs.mapInArrow(scan, docs.schema)
