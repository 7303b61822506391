"""The registered queries on the given tables, against their SQL or a plain version, and all stages on odd tables."""

from __future__ import annotations

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, jaccard, licenses, packing, preferences, quality, secrets, toxicity
from quern.llm.queries import ORACLE_SQL, QUERIES
from quern.llm.tokens import default_vocabulary, encoder
from tests.llm.test_passages import base_result

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are absent")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = encoder(default_vocabulary()).tokenizer
    return {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.execute(f"create view {p.stem} as select * from '{p}'")
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_neighbours_against_brute_force(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found, asked = {}, [i for i in rows if i % 20 == 0]
    for r in QUERIES["op1_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(asked)
    hits = 0
    for q in asked:
        assert sorted(found[q]) == list(range(1, 21))
        assert all(abs(s - float(rows[q] @ rows[i])) < 1e-12 for i, s in found[q].values())
        best = sorted((-float(rows[q] @ x), i) for i, x in rows.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for i, _ in found[q].values()})
    assert hits >= 0.9 * 20 * len(asked)


def test_packing_against_the_library(spark, ids):
    want = {}
    for d, own in ids.items():
        own = [*own, 0]
        for k, at in enumerate(range(0, len(own), 2048)):
            part = own[at : at + 2048]
            want[d, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = QUERIES["op3_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_token_files_against_the_library(spark, ids):
    at, want = 0, []
    for d in sorted(ids):
        own = [*ids[d], 1]
        want.append((d, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = QUERIES["op8_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_licenses_against_plain_words(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in QUERIES["op5_licenses"](spark, SF).collect()}
    assert got == {d: base_result(t) for d, t in texts.items()}


def test_contaminated_texts_hold_the_words_they_are_said_to(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got


@pytest.mark.parametrize("name", ["op6_quality", "op9_toxicity"])
def test_scores_cover_every_document(spark, texts, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


#: Columns named as results and helpers of any operator.
CLASHES = ["findings", "blob", "class_id", "n_links", "score", "held_out", "predicted", "piece", "length", "start", "part", "labels", "k", "item_id", "words", "prompt", "root", "rank", "label"]


def clashing(docs):
    return docs.select("doc_id", "text", *(F.lit(c).alias(c) for c in CLASHES))


def test_operators_with_columns_named_as_results(spark, odd_docs, tmp_path):
    docs, items = clashing(odd_docs), spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", 0.5)], "item_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, i % 2, 0.1) for i in range(9)], "doc_id long, quality int, toxic int, score double")
    n = docs.count()
    for module in (quality, toxicity):
        assert module.score_texts(docs, module.train(docs, labels)).count() == n
    kept = [quality.keep_good(docs, quality.train(docs, labels)), jaccard.keep_one(docs), decontaminate.clean(docs, items)]
    assert all(d.columns == docs.columns and d.count() <= n for d in kept)
    assert jaccard.jaccard_classes(docs).count() == licenses.scan_licenses(docs)[0].count() == n
    assert decontaminate.contaminated(docs, items).count() == 2
    assert packing.pack_documents(docs, default_vocabulary()).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    scanned = secrets.scan_versions(docs, f"file://{tmp_path}/l", into="found")
    assert secrets.redact(scanned, findings="found").columns == docs.columns
    turns = docs.withColumnRenamed("doc_id", "conv_id").withColumn("turn", F.lit(1)).withColumn("role", F.lit("user"))
    assert preferences.preference_pairs(preferences.swapped_replies(preferences.gather_turns(turns))).columns == ["conv_id", *preferences.RESULTS]


def test_equal_rows_of_one_id_leave_one(spark):
    rows = [(1, "same text of five words", x) for x in "cab"] + [(1, "same text of five words", None)]
    first = {r.other for k in (1, 2, 4) for r in jaccard.keep_one(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, other string").repartition(k)).collect()}
    assert len(first) == 1


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_of_odd_tables(spark, odd_docs, tmp_path, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = odd_docs.select("doc_id", "text", "lang", F.col("k").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("findings"), F.lit(1).alias("score"))
    table = docs.where("false") if kind == "empty" else odd.union(odd)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        (t.where("false") if kind == "empty" else t).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert out == []
    else:  # of equal rows one stays, and rows without an id stay too
        assert len({(r.doc_id, r.ids_crc32) for r in out}) == len(out) > 0
