"""The pipeline against plain versions of its stages."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from quern.llm import quality, secrets
from quern.llm.scratch import stage
from quern.llm.tokens import default_vocabulary, encoder
from tests.llm.conftest import split_words
from tests.llm.test_jaccard import brute
from tests.llm.test_passages import plain_score

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are absent")


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = [docs]
    for name, step in corpus_pipeline.STAGES:
        at.append(stage(step(spark, at[-1], SF), name))
    assert all(d.columns == docs.columns for d in at[:-1])
    start, good, single, clean, safe = ({r.doc_id: r.text for r in d.collect()} for d in at[:-1])

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(good) == {r.doc_id for r in quality.score_texts(docs, model).collect() if r.predicted}
    assert good.items() <= start.items()
    assert set(single) == {c for _, c, _ in brute(sorted(good.items()))}
    items = [split_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, t in single.items() if any(plain_score(i, split_words(t)) >= len(i) for i in items if set(i[:3]) & set(split_words(t)))}
    assert set(single) - set(clean) == bad
    assert set(safe) == set(clean)
    rescan = secrets.scan_versions(at[-2], f"{spark.conf.get('spark.checkpoint.dir')}/rescan", rules=secrets.BASE_RULES)
    assert rescan.where("size(findings) > 0").count() == 0
    packed = at[-1].collect()
    enc = encoder(default_vocabulary())
    assert sum(r.length for r in packed) == sum(len(enc.packed(t)) // 4 + 1 for t in safe.values())
    assert {r.doc_id for r in packed} == set(safe)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
