"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all its predecessor kept. What a stage decides takes effect:
rows of low quality, further copies and contaminated rows go, and secrets are
put out of texts. The last stage gives a row for each piece of a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard, packing, quality, secrets
from quern.llm.scratch import scratch_path, stage
from quern.llm.tokens import default_vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8, that of the least id stays."""
    return jaccard.keep_one(docs, n=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are put out of the texts; documents stay."""
    found = secrets.redact(secrets.scan_versions(docs, scratch_path(spark, "ledger"), into="__findings"), findings="__findings")
    found = found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, default_vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL can train the models or tokenise; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
