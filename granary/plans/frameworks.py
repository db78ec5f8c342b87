"""Matching a question hierarchy against a collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import HierarchyConfiguration, RerankingConfiguration, RetrievalConfiguration
from granary.operators import hierarchy, models, retrieval
from granary.plans.answers import retrieve


@dataclass(frozen=True)
class Matched:
    tree: DataFrame
    diagnostics: DataFrame
    counts: DataFrame
    judged: DataFrame
    errors: DataFrame


def match_framework(chunks: DataFrame, ontology: DataFrame, embedder: models.Embedder, analyzer: models.Analyzer, config: HierarchyConfiguration = HierarchyConfiguration()) -> Matched:
    """Retrieve for each question alone, reranked; floor the scores; let the analyzer propose; ground, de-duplicate, count.

    A response that breaks the format is listed in ``errors`` and proposes nothing.
    """
    questions = hierarchy.questions_of(ontology)
    asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"))
    found = retrieve(chunks, asked, embedder, RetrievalConfiguration(top_k=config.top_k), RerankingConfiguration(True))
    kept = retrieval.above_floor(found, config.minimum_score).withColumnRenamed("query_id", "question_id")
    retrieved = kept.select("question_id", "rank", "chunk_id", "text", "source", "page", "number", "score")
    results = retrieved.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("results"))
    responses = hierarchy.parsed_responses(analyzer.match(questions.join(results, "question_id").select("question_id", "query", "results")))
    judged = hierarchy.judged_matches(hierarchy.match_rows(responses), retrieved)
    return Matched(
        hierarchy.framework_tree(ontology, questions, judged), hierarchy.category_diagnostics(questions, retrieved, judged),
        hierarchy.question_counts(questions, retrieved, judged), judged, responses.where("error is not null").select("question_id", "error"),
    )
