"""Chunks: word windows of plain text, and passages assembled from blocks.

Word windows are DataFrame expressions. Passages follow a reading order with state
(runs that stay open, groups that carry an overlap), so the blocks of a document
meet in one row, sorted in the JVM, and each document is assembled by itself in
Arrow batches. A document is the bound of that row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.config import ChunkConfiguration
from granary.functions import identity
from granary.functions.text import dedup_form, is_boilerplate_heading, prose_of_table, section_label, topic_of_source, word_count, words
from granary.workspace import bounded_batches

_LETTER = regex.compile(r"\p{L}")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}\"“(])")
NEAR_DUPLICATE, NEAR_DUPLICATE_WORDS = 0.94, 20


def word_windows(pages: DataFrame, config: ChunkConfiguration = ChunkConfiguration()) -> DataFrame:
    """``document_id, page, word_start, word_count, text``: windows of ``pages`` (``document_id, page, text``).

    Starts are a step apart until a window reaches the page's end; a page without words has none.
    """
    step = config.word_size - config.overlap_words
    n = F.size("words")
    last = F.when(n <= config.word_size, 0).otherwise(F.ceil((n - config.word_size) / step) * step)
    split = pages.select("document_id", "page", words(F.col("text")).alias("words")).where(n > 0)
    starts = split.select("document_id", "page", "words", F.explode(F.sequence(F.lit(0), last.cast("int"), F.lit(step))).alias("word_start"))
    taken = F.slice("words", F.col("word_start") + 1, F.lit(config.word_size))
    return starts.select("document_id", "page", "word_start", F.size(taken).alias("word_count"), F.array_join(taken, " ").alias("text"))


@dataclass
class Piece:
    text: str
    page: int
    start: int
    words: int
    family: str


@dataclass
class Run:
    family: str
    section: str | None
    pieces: list[Piece] = field(default_factory=list)

    @property
    def words(self) -> int:
        return _words(self.pieces)


def _words(pieces: list[Piece]) -> int:
    return sum(p.words for p in pieces)


def split_sentences(text: str) -> list[str]:
    """Cut at white space after ``.!?`` and before a capital, a number, a quote or a bracket."""
    return _SENTENCE.split(text)


def table_groups(text: str, word_size: int) -> list[str]:
    """Rows in groups of at most ``word_size`` words, each under the header; a larger single row stays whole."""
    header, *rows = text.split("\n")
    head = len(header.split())
    groups: list[list[str]] = [[]]
    size = head
    for row in rows:
        n = len(row.split())
        if groups[-1] and size + n > word_size:
            groups.append([])
            size = head
        groups[-1].append(row)
        size += n
    return ["\n".join([header, *g]) for g in groups]


def pieces_of(kind: str, text: str, page: int, family: str, start: int, config: ChunkConfiguration) -> list[Piece]:
    """A block's pieces: sentences, a caption whole, a table's row groups; what is too long is cut into windows."""
    if kind == "table":
        return [Piece(part, page, start, n, family) for part in table_groups(text, config.word_size) if (n := len(part.split()))]
    step = config.word_size - min(config.overlap_words, config.word_size // 4)
    out = []
    for part in [text] if kind == "caption" else split_sentences(text):
        own = part.split()
        if len(own) <= config.word_size:
            if own:
                out.append(Piece(part, page, start, len(own), family))
        else:
            for at in range(0, max(1, -(-(len(own) - config.word_size) // step) * step + 1), step):
                window = own[at : at + config.word_size]
                out.append(Piece(" ".join(window), page, start + at, len(window), family))
        start += len(own)
    return out


def runs_of(blocks: list[dict], config: ChunkConfiguration) -> list[Run]:
    """Blocks (``page, type, text, section, start, next_type``) in runs of one family under one section.

    A run of too few words takes in whatever comes next, headings too.
    """
    runs: list[Run] = []
    closed = True
    for b in blocks:
        if b["type"] in ("header", "footer") or not _LETTER.search(b["text"]):
            continue
        last = runs[-1] if runs and not closed and (config.assembly == "flow" or runs[-1].pieces[-1].page == b["page"]) else None
        small = last is not None and last.words < config.minimum_words
        if b["type"] == "heading":
            if small:
                last.pieces.append(Piece(b["text"], b["page"], b["start"], len(b["text"].split()), "prose"))
            else:
                closed = True
            continue
        tabular = b["type"] == "table" or (b["type"] == "caption" and b["next_type"] == "table")
        family = "table" if tabular else "reference" if b["type"] == "reference" else "prose"
        if not (small or (last is not None and last.family == family and last.section == b["section"])):
            last = Run(family, b["section"])
            runs.append(last)
        last.pieces += pieces_of(b["type"], b["text"], b["page"], family, b["start"], config)
        closed = False
    return runs


def packed(run: Run, config: ChunkConfiguration) -> list[list[Piece]]:
    """The run's pieces in groups of at most ``word_size`` words; prose groups begin with the last pieces of the one before."""
    overlap = config.overlap_words if run.family == "prose" else 0
    groups: list[list[Piece]] = []
    carried = 0  # pieces of the last group that stand in the one before too
    for piece in run.pieces:
        if groups and _words(groups[-1]) + piece.words <= config.word_size:
            groups[-1].append(piece)
            continue
        tail: list[Piece] = []
        for p in reversed(groups[-1] if groups else []):
            if _words(tail) + p.words > overlap:
                break
            tail.insert(0, p)
        if _words(tail) + piece.words > config.word_size:
            tail = []
        carried = len(tail)
        groups.append([*tail, piece])
    if len(groups) > 1:
        fresh = groups[-1][carried:]
        if _words(fresh) < config.minimum_words and _words(groups[-2]) + _words(fresh) <= config.word_size + config.minimum_words:
            groups[-2].extend(fresh)
            groups.pop()
    return groups


def joined(pieces: list[Piece]) -> str:
    out = pieces[0].text
    for a, b in zip(pieces, pieces[1:]):
        out += ("\n" if "table" in (a.family, b.family) else " ") + b.text
    return out


def main_family(pieces: list[Piece]) -> str:
    """The family of the most words; of equals, the first."""
    total: dict[str, int] = {}
    for p in pieces:
        total[p.family] = total.get(p.family, 0) + p.words
    return max(total, key=total.__getitem__)


_GROUPS = "array<struct<ordinal:int,family:string,section:string,body:string,page:int,page_end:int,word_start:int,pages:array<int>>>"
_GROUPS_ARROW = pa.list_(pa.struct([("ordinal", pa.int32()), ("family", pa.string()), ("section", pa.string()), ("body", pa.string()), ("page", pa.int32()), ("page_end", pa.int32()), ("word_start", pa.int32()), ("pages", pa.list_(pa.int32()))]))


def _prepared(blocks: DataFrame) -> DataFrame:
    """One row a document: its blocks in order, tables of prose flattened, with word offsets in the page and the next block's type."""
    in_page = Window.partitionBy("document_id", "page").orderBy("block_no")
    prose = F.when(F.col("type") == "table", prose_of_table(F.col("text")))
    flat = blocks.withColumn("prose", prose).select(
        "document_id", "page", "block_no", F.when(F.coalesce("prose", F.lit("")) != "", "paragraph").otherwise(F.col("type")).alias("type"),
        F.when(F.coalesce("prose", F.lit("")) != "", F.col("prose")).otherwise(F.col("text")).alias("text"), "section",
    )
    placed = flat.withColumn("start", F.coalesce(F.sum(word_count(F.col("text"))).over(in_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")).withColumn("next_type", F.lead("type").over(in_page))
    return placed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "block_no", "type", "text", "section", "start", "next_type"))).alias("blocks"))


def packed_groups(blocks: DataFrame, config: ChunkConfiguration = ChunkConfiguration()) -> DataFrame:
    """``document_id, ordinal, family, section, body, page, page_end, word_start, pages``: every packed group of ``blocks``."""

    bounded_batches(blocks.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for cell in batch.column(1):  # one document at a time becomes Python values
                row = cell.as_py()
                groups = [(r, g) for r in runs_of(row, config) for g in packed(r, config)]
                out.append([{"ordinal": i, "family": main_family(g), "section": r.section, "body": joined(g), "page": g[0].page, "page_end": g[-1].page, "word_start": g[0].start, "pages": sorted({p.page for p in g})} for i, (r, g) in enumerate(groups, 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _GROUPS_ARROW)], names=["document_id", "groups"])

    kind = dict(blocks.dtypes)["document_id"]
    made = _prepared(blocks).mapInArrow(run, f"document_id {kind}, groups {_GROUPS}")
    return made.select("document_id", F.explode("groups").alias("g")).select("document_id", "g.*")


def first_of_each(texts: list[str], least: int = NEAR_DUPLICATE_WORDS, threshold: float = NEAR_DUPLICATE) -> list[int]:
    """Places of the normal forms that are neither empty nor a near-duplicate of one kept before."""
    kept: list[tuple[str, int, frozenset[str]]] = []
    places = []
    known: set[str] = set()
    for i, text in enumerate(texts):
        if not text or text in known:
            continue
        tokens = text.split(" ")
        own = frozenset(tokens)
        if len(tokens) >= least and any(n >= least and min(len(own), len(s)) >= threshold * max(len(own), len(s)) and (both := len(own & s)) / (len(own) + len(s) - both) >= threshold for _, n, s in kept):
            continue
        known.add(text)
        kept.append((text, len(tokens), own))
        places.append(i)
    return places


def without_repeats(groups: DataFrame) -> DataFrame:
    """The groups whose body isn't a near-duplicate of an earlier one of their document, by ordinal and greedily."""
    rest = [c for c in groups.columns if c not in ("document_id", "ordinal")]
    every = F.struct("ordinal", *rest)
    gathered = groups.groupBy("document_id").agg(F.array_sort(F.collect_list(every)).alias("groups")).withColumn("forms", F.transform("groups", lambda g: dedup_form(g["body"])))
    bounded_batches(groups.sparkSession)

    def run(batches):
        for batch in batches:
            kept = [first_of_each(row) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.list_(pa.int32()))], names=["document_id", "groups", "kept"])

    # The groups go along with their forms: joined to what is kept, they would all be made a second time.
    kept = gathered.mapInArrow(run, T.StructType([*gathered.schema.fields[:2], T.StructField("kept", T.ArrayType(T.IntegerType()))]))
    return kept.select("document_id", F.inline(F.transform("kept", lambda i: F.get("groups", i)))).select(*groups.columns)


def describe_documents(pages: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """``document_id, quarantined_pages, quarantine_reasons, ocr_pages, document_topic`` for each of ``documents`` (``document_id, source``).

    The topic is the first heading that reads like one and isn't boilerplate, else the source without its extension.
    """
    bad = F.col("quality") == "quarantined"
    reasons = F.array_sort(F.collect_list(F.when(bad, F.struct("page", F.coalesce("quality_reason", F.lit("unreadable after OCR")).alias("reason")))))
    by_page = pages.groupBy("document_id").agg(reasons.alias("bad"), F.array_sort(F.collect_set(F.when(F.col("quality") == "ocr", F.col("page")))).alias("ocr_pages"))
    named = blocks.where((F.col("type") == "heading") & section_label(F.col("text")).isNotNull() & ~is_boilerplate_heading(F.col("text")))
    topics = named.groupBy("document_id").agg(F.min(F.struct("page", "block_no", "text"))["text"].alias("topic"))
    out = documents.select("document_id", "source").join(by_page, "document_id", "left").join(topics, "document_id", "left")
    none = F.array().cast("array<int>")
    return out.select(
        "document_id", F.coalesce(F.transform("bad", lambda b: b["page"]), none).alias("quarantined_pages"), F.map_from_entries(F.coalesce("bad", F.array().cast("array<struct<page:int,reason:string>>"))).alias("quarantine_reasons"),
        F.coalesce("ocr_pages", none).alias("ocr_pages"), F.coalesce("topic", topic_of_source(F.col("source"))).alias("document_topic"),
    )


CHUNK_COLUMNS = ("chunk_id", "document_id", "source", "source_hash", "page", "number", "text", "metadata")


def _metadata(**known: Column) -> Column:
    kinds = {"content_type": "string", "index_fingerprint": "string", "word_count": "int", "word_start": "int", "page_end": "int", "block_type": "string", "section": "string", "document_topic": "string", "retrieval_role": "string", "extraction_quality": "string", "quarantined_pages": "array<int>", "quarantine_reasons": "map<int,string>", "row_start": "int", "row_end": "int"}
    return F.struct(*(known.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()))


def chunk_documents(documents: DataFrame, pages: DataFrame, blocks: DataFrame | None = None, config: ChunkConfiguration = ChunkConfiguration()) -> DataFrame:
    """All chunks of ``documents`` (``document_id, source, source_hash, extension``): ``CHUNK_COLUMNS``.

    ``pages``: ``document_id, page, text, quality, quality_reason``. Where ``blocks`` are given
    they make passages; without them pages make word windows. Passages come first,
    then windows, numbered from 1 in each document. Quarantined pages have neither.
    Near-duplicate and empty passages are dropped, and passages of references are auxiliary.
    """
    documents = documents.select("document_id", "source", "source_hash", "extension", identity.index_fingerprint(F.col("source_hash"), config, F.col("extension")).alias("fingerprint"))
    if blocks is None:
        readable = pages.where(~F.col("quality").eqNullSafe("quarantined")) if "quality" in pages.columns else pages
        made = word_windows(readable, config).join(documents, "document_id").select(
            "document_id", "source", "source_hash", F.col("page").cast("int").alias("page"), "text", F.lit(1).alias("kind"), F.struct("page", "word_start").alias("place"),
            identity.window_chunk_id(F.col("document_id"), F.col("page"), F.col("word_start"), config, F.col("extension")).alias("chunk_id"),
            _metadata(content_type=F.col("extension"), index_fingerprint=F.col("fingerprint"), word_count=F.col("word_count"), word_start=F.col("word_start")).alias("metadata"),
        )
    else:
        described = describe_documents(pages, blocks, documents)
        groups = without_repeats(packed_groups(blocks, config)).join(documents, "document_id").join(described, "document_id")
        label = section_label(F.col("section"))
        labelled = groups.withColumn("label", label).withColumn("text", F.concat(F.coalesce(F.concat("label", F.lit("\n")), F.lit("")), "body"))
        made = labelled.select(
            "document_id", "source", "source_hash", "page", "text", F.lit(0).alias("kind"), F.struct(F.lit(0).alias("page"), F.col("ordinal").alias("word_start")).alias("place"),
            identity.passage_chunk_id(F.col("document_id"), F.col("page"), F.col("ordinal"), config, F.col("extension")).alias("chunk_id"),
            _metadata(
                content_type=F.col("extension"), index_fingerprint=F.col("fingerprint"), word_count=word_count(F.col("text")), word_start=F.col("word_start"), page_end=F.when(F.col("page_end") != F.col("page"), F.col("page_end")),
                block_type=F.when(F.col("family") == "prose", "paragraph").otherwise(F.col("family")), section=F.col("label"), document_topic=F.col("document_topic"), retrieval_role=F.when(F.col("family") == "reference", "auxiliary").otherwise("evidence"),
                extraction_quality=F.when(F.arrays_overlap("pages", "ocr_pages"), "ocr").otherwise("extracted"), quarantined_pages=F.col("quarantined_pages"), quarantine_reasons=F.col("quarantine_reasons"),
            ).alias("metadata"),
        )
    numbered = made.withColumn("number", F.row_number().over(Window.partitionBy("document_id").orderBy("kind", "place")))
    return numbered.select(*CHUNK_COLUMNS)


def empty_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``document_id, error`` of the documents that made no chunk."""
    hint = F.when(F.col("extension") == "pdf", " OCR may be required.").otherwise("")
    return documents.join(chunks.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.concat(F.col("source"), F.lit(" contains no extractable text."), hint).alias("error"))


def require_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks``, unless some document made none: then the call fails with the error of the first by source."""
    failed = empty_documents(documents, chunks).orderBy("error").first()
    if failed:
        raise ValueError(failed["error"])
    return chunks
