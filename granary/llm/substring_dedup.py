"""Substring de-duplication with a count-min prefilter.

A window is 13 consecutive words of a document. A word goes when a window over it
also starts in a document of a smaller id. Three passes over the words:

1. Every group of documents (a few megabytes of text) makes a count-min sketch of its
   windows: for each of two hash rows the cells that its windows fall into, sorted and
   delta coded, with a counter that stops at two. Sketches are merged by ranges of
   cells: counters are added, and each group is told which of its cells came to two
   or more. The least of the two rows overestimates a window's true count, so no
   repeated window is lost.
2. Only windows estimated repeated are grouped exactly, by a 96-bit cryptographic
   hash of their words. A group sends each of them once, with its smallest document,
   and is told the smallest of all groups.
3. The groups' words are marked, removed and digested.

The sketch has no fixed size and is nowhere whole: its rows are as wide as four
times the windows, its ranges are as many as needed for a range to fit in a task,
and nothing is broadcast. Words cross no exchange: they are written once as a
bucketed table by group, and what the passes say to each other moves to them.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import SPACED, Words, bounded_batches, give_back, ids_and_texts, mix64, remove, stored, text_bytes

SPAN = 13
#: Hash rows of the sketch, cells of a row for each window, windows in a range of cells.
ROWS, CELLS, RANGE = 2, 4, 4 << 20
#: Bytes of words that make a group.
GROUP_BYTES = 4 << 20
_KEY = 12


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers by bytes of the same place, which compress apart."""
    return _pack(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(_unpack(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1)


def _bits(flags: np.ndarray) -> bytes:
    return _pack(np.packbits(flags).tobytes())


def _from_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_unpack(raw), np.uint8), count=n)


class _Group:
    """A group's words: ``text`` has one document a line, words parted by single spaces."""

    def __init__(self, text: bytes, span: int):
        self.lines = text.split(b"\n")[:-1]
        self.words = Words(self.lines, SPACED)
        self.at = np.flatnonzero(self.words.whole(span))
        self.window = self.words.grams(span)[self.at]

    def cells(self, row: int, bits: int) -> np.ndarray:
        return mix64(self.window + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)


def _grouped_words(docs: DataFrame, span: int, group_bytes: int) -> DataFrame:
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, lines, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, lines, size
            windows = sum(max(0, x.count(b" ") + 2 - span) if x else 0 for x in lines)
            row = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([windows], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(x + b"\n" for x in lines))], pa.binary())]
            number += 1
            ids, lines, size = [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["g", "ids", "windows", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(doc)
                lines.append(b" ".join([w for w in text.translate(SPACED).split(b" ") if w]))
                size += len(lines[-1]) + 1
                if size >= group_bytes:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, "g long, ids array<long>, windows long, words binary")


def _ranges(cells: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Bounds of each range in sorted cells."""
    edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**bits / ranges)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(cells, edges), [len(cells)]))


def remove_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each document; ``with_text`` adds ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+`` unchanged. Windows are judged on the input, not on
    what is left. A null or empty text has no words, a text of fewer than ``span``
    words no window. Rows that repeat an id don't remove one another, and rows
    with a null id neither remove nor lose words. One row for each input row; an
    empty table gives none. The result is written to the shared folder, so the
    words' table can go.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"granary_words_{uuid.uuid4().hex}"
    # Groups are small and go to buckets by a hash, so buckets are even; a file holds a task's groups of one bucket.
    _grouped_words(ids_and_texts(docs, id_col, text_col), span, group_bytes).write.bucketBy(parts, "g").option("compression", "none").saveAsTable(name)
    words = spark.table(name)
    total = words.agg(F.sum("windows")).first()[0] or 0
    bits = max(10, int(CELLS * total).bit_length())
    ranges = max(parts, -(-total // RANGE))

    def counters(group: _Group, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A group's different cells, which of them each window falls into, their counters and the bounds of each range."""
        cells, of, count = np.unique(group.cells(row, bits), return_inverse=True, return_counts=True)
        return cells, of, np.minimum(count, 2), _ranges(cells, bits, ranges)

    def sketch(batches):
        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                group = _Group(_unpack(text), span)
                out: list[list] = [[] for _ in range(5)]
                for row in range(ROWS):
                    cells, _, count, bounds = counters(group, row)
                    for r in np.flatnonzero(np.diff(bounds)).tolist():
                        part = slice(bounds[r], bounds[r + 1])
                        for column, value in zip(out, (row, r, g, _planes(np.diff(cells[part], prepend=np.uint64(0))), _bits(count[part] > 1)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, k) for c, k in zip(out[1:], (pa.int64(), pa.int64(), pa.binary(), pa.binary())))], names=["row", "range", "g", "cells", "twice"])
        give_back()

    def merge(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(_from_planes(x), dtype=np.uint64) for x in table.column("cells").to_pylist()]
        count = np.concatenate([1 + _from_bits(x, len(c)) for x, c in zip(table.column("twice").to_pylist(), sent, strict=True)])
        _, of = np.unique(np.concatenate(sent), return_inverse=True)
        often = np.bincount(of, count)[of] > 1
        ends = np.cumsum([len(c) for c in sent])
        told = [_bits(often[b - len(c) : b]) for b, c in zip(ends.tolist(), sent, strict=True)]
        return pa.table({"g": table.column("g"), "row": table.column("row"), "range": table.column("range"), "repeated": pa.array(told, pa.binary())})

    sent_schema = "range long, g long, keys binary, least binary, places binary, of binary"
    sent_kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row for each range of keys that the group sends, and one (of range -1) with what it keeps to itself."""
        out: list[list] = [[] for _ in range(6)]
        if left.num_rows and right.num_rows:
            g, ids = left.column("g")[0].as_py(), left.column("ids")[0].as_py()
            group = _Group(_unpack(left.column("words")[0].as_py()), span)
            told = {(r, k): bits_ for r, k, bits_ in zip(right.column("row").to_pylist(), right.column("range").to_pylist(), right.column("repeated").to_pylist(), strict=True)}
            often = np.array([i is not None for i in ids], bool)[group.words.doc[group.at]]
            for row in range(ROWS):
                _, of, _, bounds = counters(group, row)
                flags = [_from_bits(told[row, r], int(bounds[r + 1] - bounds[r])) for r in np.flatnonzero(np.diff(bounds)).tolist()]
                often &= np.concatenate(flags)[of] > 0 if flags else False
            first = group.at[often]
            starts, ends, buffer = group.words.start[first].tolist(), group.words.end[first + span - 1].tolist(), group.words.bytes
            blake = hashlib.blake2b
            keys = np.frombuffer(b"".join([blake(buffer[a:b], digest_size=_KEY).digest() for a, b in zip(starts, ends, strict=True)]), f"S{_KEY}")
            if len(keys):
                raw = keys.view(np.uint8).reshape(-1, _KEY)
                to = np.ascontiguousarray(raw[:, :4]).view("<u4").reshape(-1).astype(np.uint64) % np.uint64(ranges)
                high, low = np.ascontiguousarray(raw[:, :8]).view("<u8").reshape(-1), np.ascontiguousarray(raw[:, 8:]).view("<u4").reshape(-1)
                order = np.lexsort((low, high, to))
                new = np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
                of = np.zeros(len(keys), np.int64)
                of[order] = np.cumsum(new) - 1
                each = order[new]
                least = np.full(len(each), np.iinfo(np.int64).max)
                np.minimum.at(least, of, np.array([i or 0 for i in ids], np.int64)[group.words.doc[first]])
                for part in np.split(np.arange(len(each)), np.flatnonzero(np.diff(to[each])) + 1):
                    values = (int(to[each[part[0]]]), g, raw[each[part]].tobytes(), _planes(least[part].view(np.uint64)), None, None)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                own = (-1, g, None, None, _planes(np.diff(first.astype(np.uint64), prepend=np.uint64(0))), _planes(of.astype(np.uint64)))
                for column, value in zip(out, own, strict=True):
                    column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, sent_kinds, strict=True)], names=["range", "g", "keys", "least", "places", "of"])

    def exact(table: pa.Table) -> pa.Table:
        """For each key that a group sent, in its order, the smallest document of all groups."""
        keys = [np.frombuffer(k, np.uint8).reshape(-1, _KEY) for k in table.column("keys").to_pylist()]
        doc = np.concatenate([_from_planes(x).view(np.int64) for x in table.column("least").to_pylist()])
        flat = np.concatenate(keys)
        high, low = np.ascontiguousarray(flat[:, :8]).view("<u8").reshape(-1), np.ascontiguousarray(flat[:, 8:]).view("<u4").reshape(-1)
        order = np.lexsort((doc, low, high))
        new = np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
        least = np.zeros(len(doc), np.int64)
        least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        ends = np.cumsum([len(k) for k in keys])
        told = [_planes(least[b - len(k) : b].view(np.uint64)) for b, k in zip(ends.tolist(), keys, strict=True)]
        return pa.table({"g": table.column("g"), "range": table.column("range"), "least": pa.array(told, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=list(names))
        group = _Group(_unpack(left.column("words")[0].as_py()), span)
        ids = left.column("ids")[0].values
        n = len(group.words.start)
        delta = np.zeros(n + span + 1, np.int64)
        if right.num_rows:
            rows = {r: at for at, r in enumerate(right.column("range").to_pylist())}
            of_row = lambda name, at: _from_planes(right.column(name)[at].as_py())
            own = rows.pop(-1)
            least = np.concatenate([of_row("least", rows[r]) for r in sorted(rows)]).view(np.int64)
            places, of = np.cumsum(of_row("places", own), dtype=np.uint64).astype(np.int64), of_row("of", own).astype(np.int64)
            places = places[np.asarray(ids.fill_null(0))[group.words.doc[places]] > least[of]]
            np.add.at(delta, places, 1)
            np.add.at(delta, places + span, -1)
        gone = np.cumsum(delta)[:n] > 0
        first = group.words.first
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = before[first[1:]] - before[first[:-1]]
        texts = []
        for i, line in enumerate(group.lines):
            if removed[i]:
                line = b" ".join([w for w, x in zip(line.split(b" "), gone[first[i] : first[i + 1]].tolist(), strict=True) if not x])
            texts.append(line)
        columns = [ids, pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        if with_text:
            columns.append(pa.array([t.decode() for t in texts], pa.string()))
        return pa.table(columns, names=list(names))

    names = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string"} | ({"kept_text": "string"} if with_text else {})
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
    try:
        sketches = words.select("g", "words").mapInArrow(sketch, "row int, range long, g long, cells binary, twice binary")
        told = sketches.groupBy("row", "range").applyInArrow(merge, "g long, row int, range long, repeated binary")
        by_group = lambda df: df.groupBy("g")
        sent, sent_path = stored(by_group(words).cogroup(by_group(told)).applyInArrow(candidates, sent_schema), "substring-keys")
        least = sent.where("range >= 0").select("range", "g", "keys", "least").groupBy("range").applyInArrow(exact, "g long, range long, least binary")
        own = sent.where("range < 0").select("g", "range", "least", "places", "of")
        answers = own.unionByName(least, allowMissingColumns=True)
        done = by_group(words).cogroup(by_group(answers)).applyInArrow(finish, ", ".join(f"{k} {v}" for k, v in names.items()))
        result, _ = stored(done, "substring-dedup")
        remove(spark, sent_path)
        return result
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
