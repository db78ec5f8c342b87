"""Files as tables: uploads, text, ordered folders, JSON settings, and checks of what was selected."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import identity
from granary.functions.text import clean_text
from granary.operators.repeats import numbered

# What an upload accepts and what the chunker reads.
ACCEPTED = ("pdf", "csv", "docx", "txt", "xlsx", "md")
CHUNKED = ("pdf", "txt", "md")
MAX_FILES, MAX_MB = 10, 100


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``name, size, content, path`` of a folder's files."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), "content", "path")


def _folder_key() -> list[Column]:
    number = F.regexp_extract("name", r"-(\d+)\.pdf$", 1)
    return [F.when(number != "", number.cast("double")).otherwise(F.lit(float("inf"))), F.col("name")]


def in_folder_order(files: DataFrame) -> DataFrame:
    """By the number before the extension (``topic-12.pdf``), files without one last, then by name."""
    return files.orderBy(*_folder_key())


def folder_positions(files: DataFrame, folder: str) -> DataFrame:
    """``files`` with ``position`` from 1 in the order of their folder; no folder's files meet in one task."""
    number, name = _folder_key()
    return numbered(files.withColumn("_number", number), [folder], ["_number", "name"], "position").drop("_number")


def identified(files: DataFrame) -> DataFrame:
    """``files`` with ``extension, source, source_hash, document_id``."""
    out = files.withColumn("extension", identity.extension_of(F.col("name"))).withColumn("source", F.col("name")).withColumn("source_hash", identity.source_hash(F.col("content")))
    return out.withColumn("document_id", identity.document_id(F.col("name"), F.col("source_hash")))


def extension_error(extension: Column) -> Column:
    return F.when(~F.coalesce(extension.isin(*CHUNKED), F.lit(False)), F.concat(F.lit('Document type ".'), extension, F.lit('" is not implemented for chunking')))


def selection_errors(files: DataFrame, for_chunking: bool = True, upload: str | None = None) -> DataFrame:
    """One row ``error``: the first broken rule of an upload in ``ordinal`` order, or null; with ``upload``, a row for each value of that column.

    ``files``: ``ordinal, name, size``. Number first, then each file's type, emptiness and
    size, then what the chunker reads.
    """
    extension = identity.extension_of(F.col("name"))
    basic = (
        F.when(~extension.isin(*ACCEPTED), F.concat("name", F.lit(" is not a supported document type.")))
        .when(F.col("size") == 0, F.concat("name", F.lit(" is empty.")))
        .when(F.col("size") > MAX_MB * 1024 * 1024, F.concat("name", F.lit(f" exceeds the {MAX_MB} MB file limit.")))
    )
    later = F.when(~extension.isin(*CHUNKED), F.concat("name", F.lit(" is accepted for upload, but is not implemented in the RAG chunker yet."))) if for_chunking else F.lit(None).cast("string")
    keys = [upload] if upload else []
    judged = files.select(*keys, "ordinal", basic.alias("basic"), later.alias("later"))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("ordinal")))
    out = judged.groupBy(*keys).agg(F.count("*").alias("n"), first("basic").alias("basic"), first("later").alias("later"))
    return out.select(*keys, F.when(F.col("n") == 0, "Select at least one document.").when(F.col("n") > MAX_FILES, f"Select no more than {MAX_FILES} documents at once.").otherwise(F.coalesce("basic", "later")).alias("error"))


def text_pages(files: DataFrame) -> DataFrame:
    """``document_id, page, text, error`` of text and Markdown files: strict UTF-8, one page, Markdown kept as it is.

    Bytes that aren't UTF-8 give a null text and the error.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "^\\ufeff", "")
    error = F.when(~valid, F.concat("source", F.lit(" is not valid UTF-8 text.")))
    return files.where(F.col("extension").isin("txt", "md")).select("document_id", F.lit(1).alias("page"), F.when(valid, clean_text(text)).alias("text"), error.alias("error"))


def pdf_candidates(files: DataFrame) -> DataFrame:
    """``files`` with ``error`` where the bytes are no PDF of some size."""
    good = (F.substring("content", 1, 5) == F.lit(b"%PDF-")) & (F.length("content") >= 10_000)
    return files.withColumn("error", F.when(~good, "not a PDF"))


def read_json_setting(text: str | None, missing: str, default: Any = None) -> Any:
    """A JSON form field; blank is ``default`` where there is one, else the error ``missing``."""
    if text is None or not text.strip():
        if default is not None:
            return default
        raise ValueError(missing)
    return json.loads(text)


def read_questions(text: str | None) -> list[str]:
    found = read_json_setting(text, "Provide calibration questions as JSON.")
    if not isinstance(found, list) or not found or not all(isinstance(q, str) and q.strip() for q in found):
        raise ValueError("questions must be a non-empty array of strings.")
    return [q.strip() for q in found]


def read_checked_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with exactly these columns, all strings; an empty field is an empty string."""
    found = spark.read.option("header", True).csv(path).columns
    if found != columns:
        raise ValueError(f"Unexpected columns: {found}")
    fields = ", ".join(f"`{c}` string" for c in columns)
    # The line's end is stated: found by the reader, it is the first of whatever a part of the file holds.
    read = spark.read.schema(fields).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("charToEscapeQuoteEscaping", '"').option("lineSep", "\n").option("maxCharsPerColumn", -1)
    return read.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path).select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))
