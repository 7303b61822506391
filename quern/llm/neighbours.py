"""Approximate nearest neighbours by stable projections and a kd-tree.

Largest inner product becomes least distance when every vector gets one more
component, ``sqrt(R^2 - |x|^2)`` with R the largest norm, and a query 0. Vectors
are projected to a few dimensions by a Gaussian (2-stable) matrix: the squared
projected distance over the squared true one follows a chi-square law. So
projected neighbours are verified in order of their projected distance, a few at
a time, and the search stops when a chi-square test holds: a true neighbour
nearer than the k-th found would have shown by now with probability
``confidence``, which is thus the recall to expect or less.

1. Equal vectors fall together; each distinct one keeps its k + 1 least ids,
   which is all that any answer can need of it.
2. The top of a kd-tree over projections, fitted on a bounded sample, deals all
   vectors into cells, as many as the vectors need, and a cell that is still
   large into blocks by hash. A block holds the lower part of the tree: leaves in
   a row, each with its box.
3. Each query is answered in its own cell first. Then the test, on the boxes of
   the cells, says to which others it must go, with what it has to beat. In a
   block the test first passes over leaves by their boxes, then over vectors.

Queries travel in packs and blocks whole. No candidate cap exists; a test that
never holds verifies all. Of equal scores the smaller id ranks first. Scores are
sums in the order of the components, so they depend on the two vectors alone.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do vectors of another dimension than the commonest, nor null ids.
Repeated rows of one id and vector count once. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import stage

LEAF = 256
PACK = 1024
#: Queries that are worked on at once in a block, and projected neighbours that are verified first; then twice as many each time.
SLICE, FIRST = 256, 64
#: Distances of queries from boxes that are held at once.
BOXES = 1 << 22
#: A product of all pairs is taken where one in so many has to be verified.
DENSE = 16
#: Cells that a query visits after its own, before the test says which others.
NEAREST = 2
#: The most cells of the tree, and sampled vectors a cell for fitting it. Projections of the sample take up to 200 MB on the driver.
CELLS, FIT = 1 << 16, 16


def chi_square_limit(m: int, confidence: float) -> float:
    """The value that a chi-square variable of ``m`` (even) degrees stays below with probability ``confidence``."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        x = (lo + hi) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        lo, hi = (x, hi) if 1 - np.exp(-x / 2) * total < confidence else (lo, x)
    return hi


@dataclass
class Projection:
    matrix: np.ndarray  # (dimension + 1) x m
    norm2: float  # the largest squared norm

    def points(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + last[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1]

    def distance2(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distance at which a vector has that inner product with the query."""
        return np.maximum(self.norm2 + (x * x).sum(axis=1) - 2 * score, 0)


@dataclass
class Tree:
    """A complete kd-tree: cut dimension and value of each inner node, in heap order."""

    depth: int
    dim: np.ndarray
    cut: np.ndarray

    def cell(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.dim[at]] > self.cut[at])
        return at - (2**self.depth - 1)


def grow(p: np.ndarray, depth: int) -> Tree:
    dim, cut = np.zeros(2**depth, np.int64), np.zeros(2**depth)
    parts = {0: np.arange(len(p))}
    for node in range(2**depth - 1):
        own = parts.pop(node)
        if len(own):
            q = p[own]
            d = int(np.argmax(q.max(axis=0) - q.min(axis=0)))
            dim[node], cut[node] = d, np.median(q[:, d])
        right = p[own, dim[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return Tree(depth, dim, cut)


def leaf_order(p: np.ndarray) -> list[np.ndarray]:
    """Leaves of at most LEAF points: halves along the widest dimension, again and again."""
    todo, out = [np.arange(len(p))], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        q = p[own]
        d = int(np.argmax(q.max(axis=0) - q.min(axis=0)))
        half = np.argpartition(q[:, d], len(own) // 2)
        todo += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
    return out


def box_distance2(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least squared distance of each query from each box."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, d] - q[:, None, d], q[:, None, d] - hi[None, :, d]), 0)
        out += gap * gap
    return out


def scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed in the order of the components."""
    out = np.zeros(len(rows))
    for d in range(q.shape[1]):
        out += q[rows, d] * x[at, d]
    return out


def visit(proj: Projection, limit: float, q: np.ndarray, least: np.ndarray, k: int, ids: np.ndarray, x: np.ndarray, p: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``k`` found in a block for each query that reach ``least`` (missing ones have score -inf), and the pairs verified.

    ``p``: projections of the vectors ``x``. Rows without a bound (``least`` -inf) get one from their first k neighbours.
    """
    parts = [_visit(proj, limit, q[a : a + SLICE], least[a : a + SLICE], k, ids, x, p, ends, lo, hi) for a in range(0, len(q), SLICE)]
    return np.concatenate([r[0] for r in parts]), np.concatenate([r[1] for r in parts]), sum(r[2] for r in parts)


def _visit(proj, limit, q, least, k, ids, x, p, ends, lo, hi):
    nq, qp = len(q), proj.queries(q)
    score, best = np.full((nq, k), -np.inf), np.full((nq, k), np.iinfo(np.int64).max)

    def reach(rows: np.ndarray) -> np.ndarray:
        """The largest squared projected distance at which the test lets a vector through."""
        bound = np.maximum(score[rows, -1], least[rows])
        open_ = np.isneginf(bound)
        return np.where(open_, np.inf, limit * proj.distance2(q[rows], np.where(open_, 0, bound)) + 1e-9)

    every, dense = np.arange(nq), None
    go = box_distance2(qp, lo, hi) <= reach(every)[:, None]
    far = np.full((nq, len(x)), np.inf, np.float32)
    for leaf in np.flatnonzero(go.any(axis=0)):
        a, z, rows = (ends[leaf - 1] if leaf else 0), ends[leaf], np.flatnonzero(go[:, leaf])
        far[rows, a:z] = (qp[rows] ** 2).sum(axis=1)[:, None] + (p[a:z] ** 2).sum(axis=1)[None] - 2 * (qp[rows] @ p[a:z].T)
    width = (far <= reach(every)[:, None]).sum(axis=1)
    if DENSE * width.sum() > far.size:  # one product for all pairs is cheaper than many for some
        dense = q @ x.T
    w = max(1, int(width.max(initial=0)))
    if 2 * w < far.shape[1]:
        order = np.argpartition(far, w - 1, axis=1)[:, :w]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(far, order, 1), axis=1), 1)
    else:
        order = np.argsort(far, axis=1)[:, :w]
    done, active, verified, chunk = 0, np.flatnonzero(width), 0, max(FIRST, k)
    while len(active):
        some = order[active, done : done + chunk]
        ok = np.take_along_axis(far[active], some, 1) <= reach(active)[:, None]
        row, col = np.nonzero(ok)
        verified += len(row)
        s = np.full(some.shape, -np.inf)
        s[row, col] = dense[active[row], some[row, col]] if dense is not None else np.einsum("ij,ij->i", q[active[row]], x[some[row, col]])
        s[s < np.maximum(score[active, -1], least[active])[:, None]] = -np.inf
        better = np.flatnonzero((s > -np.inf).any(axis=1))
        if len(better):
            s, i = s[better], ids[some[better]]
            if s.shape[1] > 2 * k:  # room for ties, which ids decide
                cut = np.maximum(-np.partition(-s, k - 1, axis=1)[:, k - 1 : k], -1e300)
                n = int((s >= cut).sum(axis=1).max())
                keep = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)
                s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            i = np.where(np.isneginf(s), np.iinfo(np.int64).max, i)
            s, i = np.concatenate((score[active[better]], s), axis=1), np.concatenate((best[active[better]], i), axis=1)
            top = np.lexsort((i, -s), axis=1)[:, :k]
            score[active[better]], best[active[better]] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        done, chunk = done + some.shape[1], 2 * chunk
        active = active[width[active] > done]
        if len(active):
            active = active[far[active, order[active, done]] <= reach(active)]
    score[score < least[:, None]] = -np.inf
    best[np.isneginf(score)] = np.iinfo(np.int64).max
    return score, best, verified


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    m: int = 24,
    confidence: float = 0.95,
    block: int = 8192,
    sample: int = 20_000,
    seed: int = 1,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query row.

    ``is_query``: a condition on the columns of ``vectors``. ``m``: dimensions of
    the projection (even). ``block``: vectors that one task holds. ``sample``:
    vectors on which the top of the tree is fitted, or FIT for each of its cells
    where that is more; every vector is indexed.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("asks")).where(F.col("id").isNotNull() & v.isNotNull() & sound)
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    shapes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    answer = "query_id long, rank int, vec_id long, score double"
    if shapes is None:
        return spark.createDataFrame([], answer)
    dim = shapes["dim"]
    rows = rows.where(F.size("v") == dim)
    proj = Projection(np.random.default_rng(seed).normal(size=(dim + 1, m)), shapes["norm2"])
    limit = chi_square_limit(m, confidence)
    top = k + 1

    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.select("id", "v").withColumn("r", rank).where(F.col("r") <= top)
    classes = stage(classes.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("c"), "v", "ids"), "classes")
    n = classes.count()
    depth = 0
    while n > block * 2**depth and 2**depth < CELLS:
        depth += 1
    share = min(1.0, max(sample, FIT * 2**depth) / max(n, 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = proj.points(_matrix(b.column(1), dim)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in p], pa.binary())], ["c", "p"])

    drawn = classes.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < int(share * (1 << 30))).select("c", "v") if depth else classes.where("false").select("c", "v")
    drawn = drawn.mapInArrow(project, "c long, p binary").toArrow().sort_by("c").column("p")
    drawn = np.frombuffer(b"".join(drawn.to_pylist()), np.float32).reshape(-1, m).astype(float)
    tree = spark.sparkContext.broadcast(grow(drawn, depth))  # at most CELLS cells

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.value.cell(proj.points(_matrix(b.column(1), dim))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["c", "v", "cell"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = stage(classes.select("c", "v").mapInArrow(deal, f"c long, v {kind}, cell long"), "dealt")
    sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the cells of the tree
    parts = F.array(*(F.lit(-(-sizes.get(c, 1) // block)) for c in range(2**depth)))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("c"), F.get(parts, F.col("cell").cast("int"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, x in _groups(batches, dim):
            p = proj.points(x)
            leaves = leaf_order(p)
            order = np.concatenate(leaves)
            boxes = [np.array([f(p[own], axis=0) for own in leaves]) for f in (np.min, np.max)]
            packed = [ids[order], x[order], p[order], np.cumsum([len(own) for own in leaves]), *boxes]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), *(pa.array([a.tobytes()], pa.binary()) for a in packed)], ["cell", "ids", "x", "p", "ends", "lo", "hi"])

    groups = dealt.select("cell", "sub", "c", "v")
    blocks = stage(groups.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "c").mapInArrow(build, "cell long, ids binary, x binary, p binary, ends binary, lo binary, hi binary"), "blocks")

    asked = stage(rows.where("asks").select("id", "v").join(classes.select("v", "c"), "v").select(F.col("id").alias("query_id"), "c").distinct(), "asked")
    queries = groups.join(asked.select("c").distinct(), "c", "left_semi").select("cell", "sub", "c", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, x in _groups(batches, dim):
            for lo in range(0, len(ids), PACK):
                one = [ids[lo : lo + PACK], x[lo : lo + PACK], np.full(len(ids[lo : lo + PACK]), -np.inf)]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), *(pa.array([a.tobytes()], pa.binary()) for a in one)], ["cell", "q", "qx", "least"])

    packs = queries.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "c").mapInArrow(pack, "cell long, q binary, qx binary, least binary")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, q, qx, least, ids, x, p, ends, lo, hi in (tuple(c[r].as_py() for c in b.columns) for r in range(b.num_rows)):
                q, qx = np.frombuffer(q, np.int64), np.frombuffer(qx).reshape(-1, dim)
                block_args = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, dim), np.frombuffer(p).reshape(-1, m), np.frombuffer(ends, np.int64), np.frombuffer(lo).reshape(-1, m), np.frombuffer(hi).reshape(-1, m)
                score, best, _ = visit(proj, limit, qx, np.frombuffer(least), top, *block_args)
                has = score > -np.inf
                offs = pa.array(np.concatenate(([0], np.cumsum(has.sum(axis=1)))).astype(np.int32))
                by_id = np.argsort(block_args[0])
                at = by_id[np.searchsorted(block_args[0], best[has], sorter=by_id)]
                found = pa.StructArray.from_arrays([pa.array(-scores(qx, block_args[1], np.nonzero(has)[0], at)), pa.array(best[has])], ["worse", "c"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), cell)), pa.array(q), pa.array([r.tobytes() for r in qx], pa.binary()), pa.ListArray.from_arrays(offs, found)], ["cell", "q", "qx", "found"])

    got = "cell long, q long, qx binary, found array<struct<worse:double,c:long>>"
    columns = ["cell", "q", "qx", "least", "ids", "x", "p", "ends", "lo", "hi"]
    home = packs.join(blocks, "cell").select(columns).mapInArrow(seek, got)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, top).alias("found")
    home = home.groupBy("cell", "q").agg(F.first("qx").alias("qx"), merged)
    home = stage(home.select("q", "qx", F.array("cell").alias("been"), "found"), "home")

    def corner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = [np.frombuffer(x.as_py()).reshape(-1, m).min(axis=0) for x in b.column(1)]
            hi = [np.frombuffer(x.as_py()).reshape(-1, m).max(axis=0) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lo, pa.list_(pa.float64())), pa.array(hi, pa.list_(pa.float64()))], ["cell", "lo", "hi"])

    edges = blocks.select("cell", "lo", "hi").mapInArrow(corner, "cell long, lo array<double>, hi array<double>")
    edges = edges.groupBy("cell").agg(*(F.array(*(f(F.col(c)[i]) for i in range(m))).alias(c) for c, f in (("lo", F.min), ("hi", F.max)))).orderBy("cell").collect()
    boxes = np.array([r["cell"] for r in edges]), np.array([r["lo"] for r in edges]).reshape(-1, m), np.array([r["hi"] for r in edges]).reshape(-1, m)

    def go_on(been: DataFrame, most: int) -> DataFrame:
        """Every query in up to ``most`` cells more, those whose boxes lie nearest (0: all that the test allows)."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, lo, hi = boxes
            for batch in batches:
                for at in range(0, batch.num_rows, PACK):
                    b = batch.slice(at, PACK)
                    q, qx = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(-1, dim)
                    least = np.array([-f[top - 1]["worse"] if len(f) >= top else -np.inf for f in b.column(3).to_pylist()], float)
                    near = np.where(np.isneginf(least), np.inf, proj.distance2(qx, np.where(np.isneginf(least), 0, least)))
                    qp, own, go = proj.queries(qx), b.column(2).to_pylist(), np.zeros((len(q), len(cells)), bool)
                    rows = max(1, BOXES // len(cells))
                    for a in range(0, len(q), rows):
                        far = box_distance2(qp[a : a + rows], lo, hi)
                        for r, x in enumerate(own[a : a + rows]):
                            far[r, np.searchsorted(cells, x)] = np.inf
                        go[a : a + rows] = (far <= limit * near[a : a + rows, None] + 1e-9) & (far < np.inf)
                        if 0 < most < len(cells):
                            go[a : a + rows] &= far <= np.partition(far, most - 1, axis=1)[:, most - 1 : most]
                    for c in np.flatnonzero(go.any(axis=0)):
                        r = go[:, c]
                        yield pa.RecordBatch.from_arrays([pa.array([cells[c]]), *(pa.array([a[r].tobytes()], pa.binary()) for a in (q, qx, least))], ["cell", "q", "qx", "least"])

        away = been.sortWithinPartitions("been", "q").mapInArrow(send, "cell long, q binary, qx binary, least binary")
        return away.join(blocks, "cell").select(columns).mapInArrow(seek, got)

    if len(boxes[0]) > 1 + NEAREST:  # a better bound first, from the cells around
        more = go_on(home, NEAREST).select("q", "qx", F.array("cell").alias("been"), "found")
        home = home.union(more).groupBy("q").agg(F.first("qx").alias("qx"), F.array_distinct(F.flatten(F.collect_list("been"))).alias("been"), merged)
        home = stage(home, "around")
    found = home.select("q", "found")
    if len(boxes[0]) > 1:
        away = go_on(home, 0).select("q", "found").where(F.size("found") > 0)
        found = found.union(away).groupBy("q").agg(merged)
    wide = found.select("q", F.inline("found")).join(classes.select("c", "ids"), "c")
    per_id = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("worse"), i.alias("id")))))
    best = wide.groupBy("q").agg(F.slice(F.array_sort(per_id), 1, top).alias("best"))
    out = asked.join(best.withColumnRenamed("q", "c"), "c")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.worse")).alias("score"))


def _groups(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Rows (cell, sub, id, vector), sorted, as one group a (cell, sub)."""
    key, ids, xs = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        cell, sub, c, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), dim)
        cuts = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]))))
        for a, z in zip(cuts, np.concatenate((cuts[1:], [len(c)]))):
            if key is not None and key != (cell[a], sub[a]):
                yield key, np.concatenate(ids), np.concatenate(xs)
                ids, xs = [], []
            key = (cell[a], sub[a])
            ids.append(c[a:z])
            xs.append(x[a:z])
    if key is not None:
        yield key, np.concatenate(ids), np.concatenate(xs)
