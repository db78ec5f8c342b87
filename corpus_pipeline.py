"""Training-data pipeline: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept; all but the last return the columns of ``documents``. What a stage decides
takes effect: rejected, duplicate and contaminated documents go, secrets are
replaced in the texts, and the last stage returns the packed pieces with their ids.

Every stage takes tables without rows, null values in any column, empty and very long
texts, repeated rows and further columns of any name (but for those that start with
``_granary_``); what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, minhash_dedup, packing, quality, secrets
from granary.llm.common import remove_scratch, scratch_mark, shared_dir, table
from granary.llm.tokens import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go. Null and empty texts are judged by their features, null sources by the global prior; rows with a null id are judged too."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id. Texts without words and rows with a null id link with nothing and stay; of rows that repeat an id one stays."""
    return minhash_dedup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go. Null and empty texts have none and stay; repeated rows go or stay together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; all rows stay. Null and empty texts stay as they are."""
    return secrets.redacted_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 ids. A null or empty text is its end id alone, repeated rows are documents of their own."""
    return packing.pack(docs, tokenizer_path(packing.TOKENIZER), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", sequence_packing),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read again. All but the last are removed at the end."""
    docs = table(spark, sf_dir, "documents")
    mark, path = scratch_mark(), ""
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    remove_scratch(spark, mark, path)
    return docs
