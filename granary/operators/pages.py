"""Page quality: why a page cannot be used, the screening of whole files, and recognition of failed pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import clean_text, let, squeeze, words
from granary.workspace import shared_dir

MINIMUM_WORDS = 50


def _reason(cleaned: Column) -> Column:
    def of(text: Column, count: Column) -> Column:
        # Cleaned text has one space between tokens: they are counted without being made.
        joined = F.regexp_count(text, F.lit(r"(?<!\p{L})\p{L}{36,}+[^ ]*+"))
        return (
            F.when(text == "", "no extractable text")
            .when(text.rlike(r"(?i)^(?:#(?:NAME|REF|VALUE|DIV/0|N/A)[!?]?\s*)+$"), "spreadsheet error in place of page text")
            .when(F.regexp_count(text, F.lit("\ufffd")) > F.greatest(F.lit(2.0), F.length(text) * 0.01), "too many replacement characters")
            .when(((count <= 3) & (joined > 0)) | (joined >= F.greatest(F.lit(3.0), count * 0.1)), "probable joined words")
            .when((F.length(text) >= 100) & (count < 8), "too few word boundaries")
        )

    return let(cleaned, lambda text: let(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1, lambda count: of(text, count)))


def quality_reason(text: Column) -> Column:
    """The first rule that a page's text breaks, or null. A null text has nothing to extract."""
    return _reason(clean_text(F.coalesce(text, F.lit(""))))


def screening_reason(text: Column) -> Column:
    """As :func:`quality_reason`, without the removal of LaTeX and of hyphens."""
    return _reason(squeeze(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(" "))))


def screen_files(pages: DataFrame, file_col: str = "file", page_col: str = "page", text_col: str = "text", blank_col: str | None = None) -> DataFrame:
    """``file, ok, page, reason, pages, words``: one verdict a file.

    The first failing page rejects, then too few words; blank pages (``blank_col``)
    that hold no text are passed over. Partial aggregates only: a file's pages needn't meet.
    """
    reason = screening_reason(F.col(text_col))
    blank = F.coalesce(F.col(blank_col), F.lit(False)) if blank_col else F.lit(False)
    judged = pages.select(F.col(file_col).alias("file"), F.col(page_col).alias("page"), F.when(blank & (reason == "no extractable text"), None).otherwise(reason).alias("reason"), F.when(reason.isNull(), F.size(words(F.col(text_col)))).otherwise(0).alias("words"))
    summed = judged.groupBy("file").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("page", "reason"))).alias("bad"), F.count("*").alias("pages"), F.sum("words").alias("words"))
    few = F.col("words") < MINIMUM_WORDS
    return summed.select(
        "file", (F.col("bad").isNull() & ~few).alias("ok"), F.col("bad.page").alias("page"),
        F.coalesce(F.col("bad.reason"), F.when(few, F.lit(f"fewer than {MINIMUM_WORDS} extractable words"))).alias("reason"), "pages", "words",
    )


def recognised(pages: DataFrame, ocr: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pages`` (``document_id, page, text, blank``) with ``quality`` and ``quality_reason``.

    Only pages whose text fails go to ``ocr``, which returns ``document_id, page, text``;
    where that fails too, or is missing, the page is quarantined and its text empty.
    Blank pages are extracted pages without text.
    """
    checked = pages.select("document_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("blank", F.lit(False)).alias("blank"))
    checked = checked.withColumn("extraction", F.when(~F.col("blank"), quality_reason(F.col("text"))))
    fine = checked.where("extraction is null").select("document_id", "page", F.when(F.col("blank"), "").otherwise(F.col("text")).alias("text"), F.lit("extracted").alias("quality"), F.lit(None).cast("string").alias("quality_reason"))
    if ocr is None:
        # Nothing is read again: one pass over the pages, and no join.
        fails = F.concat(F.lit("Extraction: "), F.col("extraction"), F.lit("; OCR: no extractable text"))
        bad = F.col("extraction").isNotNull()
        return checked.select("document_id", "page", F.when(bad | F.col("blank"), "").otherwise(F.col("text")).alias("text"), F.when(bad, "quarantined").otherwise("extracted").alias("quality"), fails.alias("quality_reason"))
    # Which pages failed is written: the recogniser's branch doesn't judge all pages again.
    path = shared_dir(pages.sparkSession, "failed-pages")
    failed = checked.where("extraction is not null").select("document_id", "page", "extraction")
    failed.write.parquet(path)
    failed = pages.sparkSession.read.schema(failed.schema).parquet(path)
    read = ocr(failed.select("document_id", "page")).select("document_id", "page", F.col("text").alias("read"))
    again = failed.join(read, ["document_id", "page"], "left").withColumn("read", F.coalesce("read", F.lit(""))).withColumn("still", quality_reason(F.col("read")))
    mended = again.select(
        "document_id", "page", F.when(F.col("still").isNull(), F.col("read")).otherwise("").alias("text"), F.when(F.col("still").isNull(), "ocr").otherwise("quarantined").alias("quality"),
        F.when(F.col("still").isNotNull(), F.concat(F.lit("Extraction: "), F.col("extraction"), F.lit("; OCR: "), F.col("still"))).alias("quality_reason"),
    )
    return fine.unionByName(mended)
