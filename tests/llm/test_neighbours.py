from __future__ import annotations

import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import neighbours


TABLE = "/root/testdata/sf0.1/embeddings.parquet"


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        best = sorted(((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in rows if i != q))[:k]
        out[q] = best
    return out


def test_chi_square_limits():
    assert abs(neighbours.chi_square_limit(2, 0.95) - 5.9915) < 1e-3
    assert abs(neighbours.chi_square_limit(8, 0.99) - 20.0902) < 1e-3


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_with_unequal_norms_and_copies(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12)) * 3
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 12))) * rng.uniform(0.5, 2, (1500, 1))
    x[200:700] = x[3]  # a third are copies
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert set(got) == set(want)
    same = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert q not in [m[1] for m in mine]
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert math.isclose(s, float(np.dot(np.array(rows[q][1], float), np.array(rows[i][1], float))), rel_tol=1e-9)
        same += len({i for _, i in best} & {m[1] for m in mine})
    assert same / (10 * len(want)) >= 0.95


def search(x, confidence=0.95, m=24, k=21, block=4096):
    """All blocks of a tree for every 50th vector as a query: share verified, and recall."""
    proj = neighbours.Projection(np.random.default_rng(1).normal(size=(x.shape[1] + 1, m)), (x * x).sum(axis=1).max())
    limit, p = neighbours.chi_square_limit(m, confidence), proj.points(x)
    depth = max(0, math.ceil(math.log2(len(x) / block)))
    tree = neighbours.grow(p, depth)
    cell, q = tree.cell(p), np.arange(0, len(x), 50)
    blocks = []
    for c in range(2**depth):
        own = np.flatnonzero(cell == c)
        leaves = neighbours.leaf_order(p[own])
        at = own[np.concatenate(leaves)]
        blocks.append((at, x[at], p[at], np.cumsum([len(i) for i in leaves]), np.array([p[own][i].min(0) for i in leaves]), np.array([p[own][i].max(0) for i in leaves])))
    far = np.column_stack([neighbours.box_distance2(proj.queries(x[q]), b[4].min(0)[None], b[5].max(0)[None])[:, 0] for b in blocks])
    far[np.arange(len(q)), cell[q]] = -1
    score, seen, pairs = np.full((len(q), k), -np.inf), np.zeros(far.shape, bool), 0
    for most in (1, 1 + neighbours.NEAREST, 2**depth):
        least = score[:, -1].copy()
        go = (far <= limit * np.where(np.isneginf(least), np.inf, proj.distance2(x[q], least))[:, None]) & ~seen
        go &= far <= np.sort(far, axis=1)[:, min(most, 2**depth) - 1][:, None]
        seen |= go
        for c in np.flatnonzero(go.any(axis=0)):
            r = np.flatnonzero(go[:, c])
            s, i, n = neighbours.visit(proj, limit, x[q[r]], least[r], k, *blocks[c])
            assert (i[s > -np.inf] < len(x)).all()
            score[r] = -np.sort(-np.concatenate((score[r], s), axis=1), axis=1)[:, :k]
            pairs += n
    true = -np.sort(-(x[q] @ x.T), axis=1)[:, 1:k]
    hits = [np.isin(np.round(t, 9), np.round(s, 9)).mean() for t, s in zip(true, score)]
    return pairs / len(q) / len(x), float(np.mean(hits))


def test_search_stops_early_where_neighbours_are_near():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(800, 64)), 50, axis=0)
    x += rng.normal(0, 0.4, x.shape)
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(len(x))]
    share, recall = search(x)
    assert share <= 0.1 and recall >= 0.95


@pytest.mark.skipif(not os.path.exists(TABLE), reason="the test tables are absent")
def test_search_of_the_given_vectors():
    """Directions without neighbours: the search stops, though not early."""
    x = np.array(pq.read_table(TABLE, columns=["embedding"]).column(0).to_pylist(), float)
    share, recall = search(x, block=500)
    assert share <= 0.7 and recall >= 0.95
    assert search(x, confidence=0.5, block=500)[0] < share


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (None, [9.0, 9.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, c string, v double").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.lit(True), k=3).collect())
    assert [g[1:] for g in got if g[0] == 0] == [(1, 1, 0.5), (2, 9, 0.5), (3, 10, -1.0)]
    assert {g[0] for g in got} == {0, 1, 9, 10}
    assert neighbours.nearest(df.where("false"), F.lit(True)).collect() == []
    assert neighbours.nearest(df, F.lit(False)).collect() == []
    assert neighbours.nearest(df.where("vec_id = 0"), F.lit(True)).collect() == []
