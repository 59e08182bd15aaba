"""A training corpus from ``documents``: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm._shared import scratch, written
from loamgrid.llm.decontaminate import drop_leaks
from loamgrid.llm.language_id import fit_language_models, keep_identified
from loamgrid.llm.packing import pack_documents
from loamgrid.llm.secret_scan import redact_documents
from loamgrid.llm.similar import keep_one_similar
from loamgrid.llm.tokens import default_vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null and letterless texts go."""
    return keep_identified(docs, fit_language_models(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    return keep_one_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in token sequences."""
    return pack_documents(docs, default_vocabulary())


STAGES = [("language", identified), ("near-duplicates", deduplicated), ("benchmark", decontaminated), ("secrets", redacted), ("packing", packed)]

#: SQL can express neither the fingerprints nor the tokens; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    uri = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{uri}/{i}")
    return docs
