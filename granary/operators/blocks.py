"""Blocks of pages: running headers and footers, captions, headings, tables, paragraphs, sections.

The line-by-line rules are windows and grouped folds here. Every line gets a kind.
Text lines between breaks are a paragraph; table rows are a table until a line
flushes it (a blank or text line, or an edge, caption or heading that isn't also
a table row). A block's place is that of the line that ends it, so what such a
row emits stands before the pending table, as the rules have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import clean_text, edge_key, is_caption, is_heading, is_reference_heading, joined_lines, let, row_cells, trim


def page_lines(pages: DataFrame) -> DataFrame:
    """``document_id, page, line_no, line, last`` of ``pages`` (``document_id, page, text, quality``); quarantined pages have no lines."""
    split = F.split(trim(F.coalesce(F.col("text"), F.lit(""))), r"\r?\n")
    # The number of lines goes with each, so the page is split once and not for every line.
    lines = let(split, lambda ls: F.transform(ls, lambda x, i: F.struct((F.size(ls) - 1).alias("last"), i.alias("line_no"), trim(x).alias("line"))))
    usable = pages.where(~F.col("quality").eqNullSafe("quarantined")) if "quality" in pages.columns else pages
    return usable.select("document_id", "page", F.inline(lines))


def repeated_edges(lines: DataFrame) -> DataFrame:
    """``document_id, edge, key``: keys of first and of last lines (120 characters at most) that two pages or more share."""
    edges = F.array(F.when(F.col("line_no") == 0, F.lit("first")), F.when(F.col("line_no") == F.col("last"), F.lit("last")))
    outer = lines.where("(line_no = 0 or line_no = last) and line <> '' and length(line) <= 120")
    keys = outer.select("document_id", "page", F.explode(F.array_compact(edges)).alias("edge"), edge_key(F.col("line")).alias("key"))
    return keys.groupBy("document_id", "edge", "key").agg(F.count("*").alias("pages")).where("pages >= 2").select("document_id", "edge", "key")


def classified_lines(pages: DataFrame) -> DataFrame:
    """The lines with ``kind`` (blank, header, footer, caption, heading, row, text), ``cells`` and ``is_row``.

    ``cells`` are those of lines with a tab or three spaces, null for others, which are no rows.
    Pages are dealt by document once; all that follows works on that dealing.
    """
    lines = page_lines(pages.repartition("document_id"))
    line = F.col("line")
    first, last = (F.col("line_no") == 0) & (line != ""), (F.col("line_no") == F.col("last")) & (line != "")
    keyed = lines.withColumn("first_key", F.when(first, edge_key(line))).withColumn("last_key", F.when(last, edge_key(line))).withColumn("cells", F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("   ")), row_cells(line)))
    keyed = keyed.withColumn("caption", is_caption(line)).withColumn("heading", is_heading(line))
    short = F.when(F.length("line") <= 120, 1).otherwise(0)
    shared = lambda key: F.when(F.col(key).isNotNull(), F.sum(short).over(Window.partitionBy("document_id", key)) >= 2)
    found = keyed.withColumn("header", shared("first_key")).withColumn("footer", shared("last_key"))
    found = found.withColumn("is_row", F.coalesce((F.size("cells") >= 3) | ((F.size("cells") >= 2) & F.contains(line, F.lit("\t"))), F.lit(False)))
    kind = (
        F.when(line == "", "blank").when(F.col("header"), "header").when(F.col("footer") | (last & line.rlike(r"^\d+$")), "footer")
        .when(F.col("caption"), "caption").when(F.col("heading"), "heading").when(F.col("is_row"), "row").otherwise("text")
    )
    return found.select("document_id", "page", "line_no", "line", "cells", "is_row", kind.alias("kind"))


def structure_blocks(pages: DataFrame) -> DataFrame:
    """``document_id, page, block_no, type, text, section`` of ``pages``, in reading order.

    Types: header, footer, caption, heading, table, paragraph, reference. The section
    is that of the last heading before, over pages too; under a heading of references
    paragraphs are references. One exchange, of the pages by document; a
    document's lines are sorted there and grouped by block.
    """
    lines = classified_lines(pages)
    in_page = Window.partitionBy("document_id", "page").orderBy("line_no")
    so_far = Window.partitionBy("document_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    single = F.col("kind").isin("header", "footer", "caption", "heading")
    flushes = F.col("kind").isin("blank", "text") | (single & ~F.col("is_row"))
    continued = F.lag("kind").over(in_page).eqNullSafe("text") & ~F.lag(F.col("line").rlike(r"[.!?]$")).over(in_page)
    marked = (
        lines.withColumn("section", F.last(F.when(F.col("kind") == "heading", clean_text(F.col("line"))), ignorenulls=True).over(so_far))
        .withColumn("paragraph", F.sum(F.when((F.col("kind") == "text") & continued, 0).otherwise(1)).over(in_page))
        .withColumn("table", F.sum(flushes.cast("int")).over(in_page))
    )
    # A line belongs to its own block, to a paragraph or to a table; one that is an own block amid a table to both.
    member = lambda kind, number: F.struct(F.lit(kind).alias("of"), number.cast("int").alias("number"))
    groups = F.array_compact(F.array(F.when(single, member("own", F.col("line_no"))), F.when(F.col("kind") == "text", member("paragraph", F.col("paragraph"))), F.when(~flushes, member("table", F.col("table")))))
    each = marked.withColumn("g", F.explode(groups)).select("document_id", "page", "g.of", "g.number", "line_no", "kind", "line", "cells", "section")
    ordered = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_no", value.alias("v"))))), lambda x: x["v"])
    # The last line before a flush settles a block's place and section.
    made = each.groupBy("document_id", "page", "of", "number").agg(
        F.max(F.struct("line_no", "section")).alias("until"), F.min("kind").alias("kind"), ordered(F.col("line"), F.col("of") != "table").alias("lines"), ordered(F.array_join("cells", " | "), (F.col("of") == "table") & (F.col("kind") == "row")).alias("rows")
    )
    reference = F.coalesce(is_reference_heading(F.col("until.section")), F.lit(False))
    text = F.when(F.col("of") == "own", clean_text(F.get("lines", F.lit(0)))).when(F.col("of") == "paragraph", joined_lines(F.col("lines"))).otherwise(F.array_join("rows", "\n"))
    kind = F.when(F.col("of") == "own", F.col("kind")).when(F.col("of") == "paragraph", F.when(reference, "reference").otherwise("paragraph")).otherwise("table")
    every = made.select("document_id", "page", F.col("until.line_no").alias("at"), (F.col("of") != "own").cast("int").alias("after"), kind.alias("type"), text.alias("text"), F.col("until.section").alias("section"))
    # Empty blocks have no number. They go after the numbering, so that a filter doesn't make every text twice.
    so_many = Window.partitionBy("document_id", "page").orderBy("at", "after").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum(F.when(F.col("text") != "", 1).otherwise(0)).over(so_many).cast("int")
    return every.select("document_id", "page", number.alias("block_no"), "type", "text", "section").where("text <> ''")


def rebuilt_text(blocks: DataFrame) -> DataFrame:
    """``document_id, page, text``: the texts of a page's blocks, a line each."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"])
    return blocks.groupBy("document_id", "page").agg(F.array_join(texts, "\n").alias("text"))
