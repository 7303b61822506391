"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard, licenses, neighbours, packing, preferences, quality, secrets, token_files, toxicity
from quern.llm.scratch import scratch_path
from quern.llm.sql import ORACLE_SQL
from quern.llm.tokens import default_vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), capacity=2048, end_id=0)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))[0].drop("rid")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, default_vocabulary(), end_id=1)
    return token_files.digests(token_files.read_token_files(spark, path))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules come first; then the whole list, of which the ledger lacks the others."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "ledger")
    secrets.update_ledger(docs, ledger, rules=secrets.BASE_RULES)
    found = secrets.scan_versions(docs, ledger)
    base = F.filter("findings", lambda x: x["rank"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id",
        *(secrets.count_of("findings", r).alias(f"n_{r.kind}") for r in secrets.BASE_RULES),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_texts(docs, quality.train(docs, labels), threshold=0.3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_texts(docs, toxicity.train(docs, labels), threshold=0.5)


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = preferences.gather_turns(table(spark, sf_dir, "conversations"))
    return preferences.preference_pairs(preferences.swapped_replies(conversations))


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_decontaminate": op2_decontaminate,
    "op3_packing": op3_packing,
    "op4_jaccard": op4_jaccard,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_preferences": op10_preferences,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
