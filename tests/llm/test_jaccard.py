from __future__ import annotations

import random

import pytest

from quern.llm import components, jaccard
from tests.llm.conftest import split_words


def shingles(text, n=5):
    w = split_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets, root, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    tops = [top(i) for i in range(len(rows))]
    low = {t: min((rows[i][0] for i in range(len(rows)) if tops[i] == t and rows[i][0] is not None), default=None) for t in set(tops)}
    return [(rows[i][0], low[tops[i]], links[i]) for i in range(len(rows))]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("block", [4096, 7])
def test_against_all_pairs(spark, block):
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(1 if group else 25):
            rows.append((len(rows), " ".join(base)))
        for edits in [0, 1, 1, 2, 3, 5, 8, 13] * (4 if group == 1 else 1):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=block)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in jaccard.jaccard_classes(odd_docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted({(min((d or 0) for d, u in rows if (u or "") == (t or "")), t or "") for _, t in rows})
    assert jaccard.jaccard_classes(no_docs).collect() == []
    assert jaccard.keep_one(no_docs).collect() == []


def test_posterior_limits():
    least = jaccard.least_matches(0.8, 1e-4)
    assert all(least[n] <= n * 0.8 for n in range(1, jaccard.HASHES + 1))
    assert (least[1:] - least[:-1]).min() >= 0
    assert least[jaccard.HASHES] > 0.6 * jaccard.HASHES


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (200, 202), (202, 203)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 204)}}
