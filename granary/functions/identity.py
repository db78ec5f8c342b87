"""Deterministic keys of files, chunks, index states and stored points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.config import ChunkConfiguration

# The namespace of point ids and the versions that keys carry.
POINT_NAMESPACE = "47129d6b-906b-4c39-98fd-76c3ac5a0060"
INDEX_VERSION = "document-processing-v2"
PASSAGE_VERSION = "structured-v2"


def sha1(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def _joined(*parts) -> Column:
    return sha1(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def source_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def document_id(name: Column, content_hash: Column) -> Column:
    """The same bytes under another name are another document; case doesn't count."""
    return _joined(F.lower(name), content_hash)


def window_chunk_id(document: Column, page: Column, start: Column, config: ChunkConfiguration, extension: Column) -> Column:
    return _joined(document, page, start, config.word_size, config.overlap_words, extension)


def passage_chunk_id(document: Column, page: Column, ordinal: Column, config: ChunkConfiguration, extension: Column) -> Column:
    return _joined(document, page, ordinal, config.word_size, config.overlap_words, extension, f"{PASSAGE_VERSION}-{config.assembly}")


def index_fingerprint(content_hash: Column, config: ChunkConfiguration, extension: Column) -> Column:
    return _joined(content_hash, config.word_size, config.overlap_words, extension, config.assembly, INDEX_VERSION)


def point_id(chunk_id: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """UUID version 5 of a chunk id."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(chunk_id, "utf-8")))
    nibble = F.conv(digest.substr(17, 1), 16, 10).cast("int")
    variant = F.get(F.array(*(F.lit(x) for x in "89ab")), F.pmod(nibble, F.lit(4)))
    return F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), F.concat(F.lit("5"), digest.substr(14, 3)), F.concat(variant, digest.substr(18, 3)), digest.substr(21, 12))


def extension_of(name: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name where there is none."""
    return F.lower(F.substring_index(name, ".", -1))
