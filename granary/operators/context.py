"""Word-budgeted context of ranked passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import WS, context_label, trim

ANSWER_WORDS, HIERARCHY_WORDS = 1200, 4000


def budgeted(results: DataFrame, budget: int, empty_counts: bool) -> DataFrame:
    """``results`` (``query_id, rank, text``) cut to ``budget`` words a query: ``kept`` (words) and ``used_before``.

    A running sum over the ranks; the passage that reaches the budget is cut, those
    after it go. ``empty_counts``: a text without words takes one.
    """
    split = F.split(trim(F.col("text")), f"{WS}+")
    words = split if empty_counts else F.filter(split, lambda w: w != "")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sized = results.withColumn("words", words).withColumn("used_before", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)))
    return sized.where(F.col("used_before") < budget).withColumn("kept", F.slice("words", 1, F.least(F.size("words"), F.lit(budget) - F.col("used_before")).cast("int"))).drop("words")


def _context(cut: DataFrame, header: Column) -> DataFrame:
    section = F.concat(header, F.lit("\n"), F.array_join("kept", " "))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", section.alias("section")))), lambda x: x["section"])
    return cut.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"), F.sum(F.size("kept")).alias("words"), F.count("*").alias("passages"))


def answer_context(results: DataFrame, budget: int = ANSWER_WORDS) -> DataFrame:
    """``query_id, context, words, passages`` of ``query_id, rank, text, source, page, content_type, row_start, row_end``."""
    cut = budgeted(results, budget, True)
    return _context(cut, context_label(F.col("source"), F.col("page"), F.col("content_type"), F.col("row_start"), F.col("row_end")))


def hierarchy_context(results: DataFrame, budget: int = HIERARCHY_WORDS) -> DataFrame:
    """As :func:`answer_context`, under headers with the chunk's id (``chunk_id, source, page``)."""
    cut = budgeted(results, budget, False)
    return _context(cut, F.concat(F.lit("[Chunk "), F.col("chunk_id").cast("string"), F.lit("] [Source: "), F.col("source"), F.lit("] [Page "), F.col("page").cast("string"), F.lit("]")))
