"""The two classifiers: tables and products against plain sums, odd rows, and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_measures_of_texts():
    x = quality.measure(pa.array(["AB, ab ab!!", None, ""]))
    at = quality.FEATURES.index
    assert x.shape == (3, len(quality.FEATURES))
    assert x[0, at("upper")] == 2 / 11 and x[0, at("distinct_words")] == 1 / 3 and x[0, at("top_word")] == 1 and x[0, at("repeated_marks")] == 1 / 11
    assert (x[1] == x[2]).all()
    assert quality.measure(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = np.zeros((3000, len(quality.FEATURES)))
    x[:, 2], x[:, 5] = rng.random(3000), rng.random(3000)
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (2, 5) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    b, z = model.bins(x[:5]), []
    for r in b:
        z.append(model.base + sum(t[r[f]] for f, t in enumerate(model.tables)) + sum(t[r[f], r[g]] for (f, g), t in zip(model.pairs, model.pair_tables)))
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-np.array(z))))
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_machine_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1], [3, 4]]
    term, row = np.array([t for r in rows for t in r]), np.array([i for i, r in enumerate(rows) for _ in r])
    want = [0.3 + sum(m.weight[t] for t in r) + sum(m.vector[a] @ m.vector[b] for i, a in enumerate(r) for b in r[:i]) for r in rows]
    assert np.allclose(m.margins(term, row, 4), want)


def test_repeats_against_plain_counts():
    rng = np.random.default_rng(6)
    sizes = rng.integers(0, 9, 2500)
    row = np.repeat(np.arange(2500), sizes)
    values = (rng.integers(0, 5, len(row)).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    kinds, most = quality.repeats(values, row, 2500)
    for i in range(2500):
        k = np.unique(values[row == i], return_counts=True)[1]
        assert (kinds[i], most[i]) == (len(k), k.max(initial=0))
    assert [x.tolist() for x in quality.repeats(values[:0], row[:0], 3)] == [[0] * 3] * 2


def test_a_term_that_tells_nothing_alone():
    """``clan`` is as common in either class; beside ``vile`` it decides."""
    rng = random.Random(3)
    texts, y = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["vile"] * insult + ["clan"] * group + [f"w{rng.randint(0, 400)}" for _ in range(8)]))
        y.append(float(insult == group))
    terms, rows = toxicity.distinct_terms(*toxicity.hashed_terms(pa.array(texts)))
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    model = toxicity.fit([terms[a:z] for a, z in zip(ends[:-1], ends[1:])], np.array(y), rate=0.03)
    s = model.score(pa.array(["vile w1", "clan w1", "vile clan w1", "w1"]))
    assert min(s[2], s[3]) > 0.7 and max(s[0], s[1]) < 0.3


def test_teaching_rows_are_bounded(spark):
    from quern.llm.labelled import training_rows

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, f"long {'x ' * 50_000}") for i in range(2, 30)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    rows = lambda n: training_rows(docs, labels, "toxic", lambda texts: texts, "string", id_col="doc_id", text_col="text", sample=n)
    assert rows(10).count() <= 10
    assert rows(1000).where("x like 'text %'").count() == 1 and rows(1000).count() == len([i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5])
    model = toxicity.train(docs, labels)
    assert len(model.known) <= 200 and toxicity.score_texts(docs, model).count() == docs.count()


def test_machine_learns_a_product():
    rng = random.Random(2)
    texts, y = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["vile"] * insult + ["clan"] * group + [f"w{rng.randint(0, 40)}" for _ in range(5)]))
        y.append(float(insult and group))
    col = pa.array(texts)
    terms, rows = toxicity.distinct_terms(*toxicity.hashed_terms(col))
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    model = toxicity.fit([terms[a:z] for a, z in zip(ends[:-1], ends[1:])], np.array(y))
    s = model.score(pa.array(["vile w1", "clan w1", "vile clan w1", "", None]))
    assert s[2] > 0.9 and s[0] < 0.2 and s[1] < 0.2 and s[3] == s[4] < 0.5


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd_docs, no_docs, module, label):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (5, 1), (7, 0), (8, 0), (None, 1), (1, 1), (99, 1)], f"doc_id long, {label} int")
    model = module.train(odd_docs, labels)
    got = module.score_texts(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert module.score_texts(no_docs, model).collect() == []
    blank = module.train(odd_docs, labels.where("false"))
    assert {r.score for r in module.score_texts(odd_docs, blank).collect()} == {0.5}
    module.train(no_docs, labels)


def test_quality_filter_keeps_columns(spark, odd_docs, no_docs):
    model = quality.train(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted(map(str, quality.keep_good(odd_docs, model).collect())) == sorted(map(str, odd_docs.collect()))
    assert quality.keep_good(odd_docs, model, threshold=0.9).count() == 0
    assert quality.keep_good(no_docs, model).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are absent")
@pytest.mark.parametrize("module, label, threshold", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, module, label, threshold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = module.score_texts(docs, module.train(docs, labels), threshold=threshold).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("predicted") == F.col(label)).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.9
