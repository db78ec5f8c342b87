"""From documents and questions to grounded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import RerankingConfiguration, RetrievalConfiguration
from granary.functions.text import question_error
from granary.operators import context, models, retrieval
from granary.workspace import written


def retrieve(chunks: DataFrame, questions: DataFrame, embedder: models.Embedder | None = None, config: RetrievalConfiguration = RetrievalConfiguration(), reranking: RerankingConfiguration = RerankingConfiguration(), scorer: retrieval.Scorer | models.BatchScorer = retrieval.overlap_logit) -> DataFrame:
    """``query_id, question, chunk_id, rank, score, dense_score, sparse_score`` with the chunk's columns.

    ``chunks`` (already scoped) may hold ``dense``; without it the embedder makes it where a strategy needs it.
    ``questions``: ``query_id, text``. Each leg keeps its candidates; fused scores leave both leg
    scores null. With reranking the legs keep as many as it takes. Texts are read once for the vectors, once
    for the terms and once for the few results, which are written before and after they get their texts.
    """
    limit = reranking.candidates if reranking.enabled else config.top_k
    if reranking.enabled and reranking.strategy != "cross_encoder":
        raise ValueError("Lexical reranking is not implemented.")
    if config.strategy not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"Unknown strategy {config.strategy}.")
    vectors = lambda: chunks if "dense" in chunks.columns else embedder.embed(chunks.select("chunk_id", "text"))
    dense = lambda k: retrieval.dense_search(vectors(), embedder.embed_queries(questions), k)
    sparse = lambda k: retrieval.sparse_search(chunks, questions, k)
    none = F.lit(None).cast("double")
    if config.strategy == "dense":
        found = dense(limit).withColumn("dense_score", F.col("score")).withColumn("sparse_score", none)
    elif config.strategy == "sparse":
        found = sparse(limit).withColumn("dense_score", none).withColumn("sparse_score", F.col("score"))
    else:
        legs = [dense(max(limit, config.dense_candidates)), sparse(max(limit, config.sparse_candidates))]
        found = retrieval.fuse(legs, limit, config.rrf_k, config.rank_base).withColumn("dense_score", none).withColumn("sparse_score", none)
    # The few results meet the chunks first, so that Spark knows how few they are and moves no text.
    named = written(found, "found").join(chunks.drop("dense"), "chunk_id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    named = written(named, "results")
    return retrieval.rerank(named, config.top_k, scorer).withColumn("reranker_score", F.col("score")) if reranking.enabled else named


def answer(chunks: DataFrame, questions: DataFrame, embedder: models.Embedder, generator: models.Generator, config: RetrievalConfiguration = RetrievalConfiguration(), reranking: RerankingConfiguration = RerankingConfiguration(), budget: int = context.ANSWER_WORDS, results: DataFrame | None = None) -> DataFrame:
    """``query_id, question, context, answer`` of each question; a question that is blank or too long has the error as its answer.

    ``results``: what :func:`retrieve` gave for the questions, where it was called already.
    """
    judged = questions.withColumn("error", question_error(F.col("text")))
    fine = judged.where("error is null").drop("error")
    results = retrieve(chunks, fine, embedder, config, reranking) if results is None else results
    cited = results.select("query_id", "rank", "text", "source", "page", F.col("metadata.content_type").alias("content_type"), F.col("metadata.row_start").alias("row_start"), F.col("metadata.row_end").alias("row_end"))
    prompts = fine.select("query_id", F.col("text").alias("question")).join(context.answer_context(cited, budget).select("query_id", "context"), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    answers = prompts.join(generator.generate(prompts), "query_id")
    bad = judged.where("error is not null").select("query_id", F.col("text").alias("question"), F.lit("").alias("context"), F.col("error").alias("answer"))
    return answers.select("query_id", "question", "context", "answer").unionByName(bad)
