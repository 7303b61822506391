"""Benchmark passages and license statements."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quern.llm import align, decontaminate, licenses, seeds, words
from tests.llm.conftest import split_words


def plain_score(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(max(0, row[i] + (2 if x == y else -1), row[i + 1] - 1, new[i] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_against_plain_version():
    rng = random.Random(3)
    pairs = [(np.array([rng.randint(2, 5) for _ in range(rng.randint(0, 9))], np.uint64), np.array([rng.randint(2, 5) for _ in range(rng.randint(0, 14))], np.uint64)) for _ in range(80)]
    score, start, end = align.local_scores(pairs)
    for (a, b), s, x, z in zip(pairs, score, start, end):
        assert s == plain_score(a.tolist(), b.tolist())
        assert s == plain_score(a.tolist(), b[x:z].tolist())


def edited(words_, share, rng):
    return [f"z{rng.random()}" if rng.random() < share else w for w in words_]


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(12)]
    rows, want = [], set()
    for d in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if d % 3 == 0:
            i = d % 12 if d % 2 else 0
            at = rng.randrange(len(w))
            w[at:at] = edited(items[i][1].split(), [0, 0.1, 0.15][d % 9 // 3], rng)
            want.add((d, i))
        rows.append((d, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    for r in got.collect():
        full = plain_score(split_words(items[r.item_id][1]), split_words(rows[r.doc_id][1])) / 80
        assert abs(r.score - full) < 1e-9
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_finds_heavy_edits_beside_an_exact_copy(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(8)]
    rows, want = [], set()
    for i, text in items:
        w = text.split()
        spaced = [f"z{j}" if j > 6 and j % 4 == 3 else x for j, x in enumerate(w)]
        for copy in (w, spaced, *(edited(w, share, rng) for share in (0.2, 0.25, 0.3))):
            d, copy = len(rows), split_words(" ".join(copy))
            rows.append((d, " ".join(["before", *copy, "after"])))
            if plain_score(w, copy) >= 40 and any(w[j : j + 4] == copy[a : a + 4] for j in range(37) for a in range(len(copy) - 3)):
                want.add((d, i))
    assert {(5 * i + k, i) for i in range(8) for k in (0, 1)} < want
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_finds_items_shorter_than_a_seed(spark):
    items = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "beta, gamma"), (3, "alpha"), (4, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "beta gamma"), (3, "alpha gamma beta"), (4, "zero one two three four five six"), (5, "beta"), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1, 1.0, 1, 4), (1, 2, 1.0, 2, 4), (2, 2, 1.0, 0, 2), (4, 4, 1.0, 1, 6)]


def test_recall_of_paraphrased_copies(spark):
    """Copies with 20, 30 and 40 % of the words replaced: of those that score, nearly all keep a seed."""
    rng = random.Random(12)
    items = [(i, " ".join(f"i{i}w{rng.randint(0, 999)}" for _ in range(rng.randint(14, 59)))) for i in range(60)]
    rows, should = [], {0.2: set(), 0.3: set(), 0.4: set()}
    for share in should:
        for i, text in items:
            copy = edited(text.split(), share, rng)
            if plain_score(split_words(text), split_words(" ".join(copy))) >= len(split_words(text)):
                should[share].add((len(rows), i))
            rows.append((len(rows), " ".join(["before"] * 30 + copy + ["after"] * 30)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= set().union(*should.values())
    assert len(should[0.2]) > 20
    for least, w in zip((0.98, 0.95), should.values()):
        assert len(got & w) >= least * len(w)


def test_decontamination_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "x"), (2, None, "x"), (3, "", None), (4, "two words", "y"), (5, "quick brown fox jumps over the lazy dog", "z")], "item_id long, text string, score string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.end_word) for r in decontaminate.contaminated(odd_docs, bench).collect())
    assert got == [(1, 1, 1, 9), (1, 5, 1, 9), (2, 1, 1, 9), (2, 5, 1, 9)]
    far = spark.createDataFrame([(1, "x " * 300_000 + "quick brown fox jumps over the lazy dog" + " y" * 300_000, "c")], "doc_id long, text string, item_id string")
    assert [(r.doc_id, r.item_id, r.score, r.first_word) for r in decontaminate.contaminated(far, bench.where("item_id = 1")).collect()] == [(1, 1, 1.0, 300_000)]
    assert decontaminate.clean(far, bench).columns == far.columns and decontaminate.clean(far, bench).count() == 0
    left = decontaminate.clean(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 3
    assert decontaminate.contaminated(no_docs, bench).collect() == []
    assert decontaminate.contaminated(odd_docs, bench.where("false")).collect() == []
    assert decontaminate.clean(odd_docs, bench.where("false")).count() == odd_docs.count()


def test_filter_of_table_equals_filter_of_values(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "gram long")
    assert (seeds.filter_of_table(df, "gram") == seeds.filter_of(h)).all()


def test_regions_cover_hits_with_padding():
    h, offs = words.word_hashes(pa.array(["a b c d e f g h i j", None, "x c d e y"]))
    known = seeds.filter_of(words.ngrams(words.hash_words(["c d e"]), 3))
    got = list(seeds.regions_of(h, offs, 3, known, 2))
    assert [(r, s, len(w), at.tolist()) for r, s, w, at, _ in got] == [(0, 0, 7, [2]), (2, 0, 5, [1])]


def base_result(text):
    w, found, labels = split_words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                found.append(i)
                labels.add(label)
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def test_short_license_statements_with_changes(spark):
    texts = {
        "Licensed under the Apache License 2.0": "apache-2.0", "Licensed under the terms of the Apache License, Version 2.0": "apache-2.0", "Released under the terms of the MIT License": "mit",
        "Licensed under the Apache License, Version 1.1": "", "Licensed under the Zope License, Version 2.0": "", "Released under the BSD License": "", "Released under an MIT License": "",
    }
    docs = spark.createDataFrame([(i, f"some words before. {t}, and some after") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs)[0].collect()}
    assert got == dict(enumerate(texts.values()))


def test_licenses(spark, odd_docs, no_docs):
    texts = [
        "All Rights reserved. all rights all rights reserved", "Licensed under CC-BY 4.0 and the GNU General   Public License", "x " * 50 + "Released under the MIT License. " + "y " * 50,
        "licensed under the apache license version 2.0", "licensed under cc by nc 4 0", "Permission is hereby granted, free and without charge, to any one person obtaining a copy of this software and its associated documentation files, to deal in the Software without restriction",
        "the mit license plate of a car", "rights reserved all", None, "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs, spans = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {r.doc_id: r for r in docs.collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_result(t)
        assert 0 <= r.score <= 1
    assert got[2].labels == "mit" and got[3].labels == "apache-2.0" and got[4].labels == "cc-by,cc-by-nc" and got[5].labels == "mit"
    assert [got[i].labels for i in (6, 7, 8, 9)] == [""] * 4
    assert {(r.doc_id, r.label, r.first_word, r.end_word) for r in spans.collect()} >= {(2, "mit", 50, 55)}
    odd = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(odd_docs)[0].collect()), key=str)
    assert odd == sorted(((r.doc_id is None, r.doc_id, *base_result(r.text)) for r in odd_docs.collect()), key=str)
    assert licenses.scan_licenses(no_docs)[0].collect() == []
