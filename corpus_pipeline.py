"""The corpus pipeline: quality rules, line dedup, near-dedup by Jaccard similarity, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes each result as
Parquet in the shared folder and reads it again. Every stage but the last returns the columns of documents, with n_chars
following the text. Nulls, empty texts, repeated rows and empty tables have the results that the operators' modules state.
Rows that share a doc_id, or have none, are documents of their own wherever their texts differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm import lines, near, packing, pii, quality
from logfold.llm.common import discard, stored, table

#: Words in a shingle of the near-duplicate stage, and the Jaccard similarity that links documents.
SHINGLE = 5
SIMILARITY = 0.8

#: SQL has no regression trees, MinHash or tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    if "n_chars" in names:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*[f"`{c}`" for c in names])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line but the first of its near-duplicates taken out."""
    return _counted(lines.dedup(docs), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by doc_id (null last), then text hash. Candidates come from
    the SimHash operator's grid join and from MinHash bands; links are exact."""
    return near.one_of_each(docs, SIMILARITY, SHINGLE)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return _counted(pii.redact_documents(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_stage),
    ("personal_data", personal_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
