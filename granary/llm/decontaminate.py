"""Benchmark decontamination by winnowing.

Fingerprints are the minimum k-gram hashes of every ``WINDOW`` consecutive k-grams,
so any shared span of ``K + WINDOW - 1`` words or more has a fingerprint in common
(Schleimer, Wilkerson and Aiken 2003). With 5-grams and windows of 6 that is 10
words, the span that counts. Fingerprints of documents are joined with those of
the benchmark, and each hit is extended word by word in both directions to the
longest common run. Items of fewer than 10 words have no such window; they are one
window each and are found by a gram of their own length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import FOLDED, Words, arrow_map, grams, ids_and_texts, remove, stored, text_bytes

SPAN, K = 10, 5
WINDOW = SPAN - K + 1
#: Bytes of benchmark text in one block. A block's fingerprints go to every task; more text makes more blocks.
BLOCK_BYTES = 32 << 20


def winnowed(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints: the rightmost minimum of each window of ``width`` k-gram hashes.

    ``first`` are the places at which texts start (and the end); a window lies in one text.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = hashes[width - 1 :].copy(), np.arange(width - 1, len(hashes))
    for back in range(width - 2, -1, -1):  # to the left: only a smaller hash replaces
        left = hashes[back : back + n]
        less = left < least
        least[less] = left[less]
        place[less] = np.flatnonzero(less) + back
    text = np.searchsorted(first, np.arange(n), side="right")
    inside = text == np.searchsorted(first, np.arange(n) + width + K - 2, side="right")
    return np.unique(place[inside])


class Block:
    """The index of one block of benchmark items: fingerprint -> places."""

    def __init__(self, items: list[tuple[int, bytes]]):
        words = Words([t for _, t in items], FOLDED)
        self.ids = [i for i, _ in items]
        self.hash, self.first, self.item = words.hash, words.first, words.doc
        lengths = np.diff(words.first)
        self.long = lengths >= SPAN
        prints = winnowed(grams(words.hash, K), words.first)
        keys = grams(words.hash, K)[prints]
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], prints[order]
        #: Short items by length: gram hash -> items.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((lengths > 0) & ~self.long).tolist():
            n = int(lengths[i])
            key = int(grams(words.hash[words.first[i] : words.first[i + 1]], n)[0])
            self.short.setdefault(n, defaultdict(list))[key].append(i)
        self.short_keys = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.short.items()}

    def search(self, words: Words) -> list[tuple[int, int, int, int]]:
        """``(document, start, end, item)``: runs of hit words, by place in ``words``; each run holds a window of the item."""
        found: list[tuple[int, int, int, int]] = []
        h = words.hash
        if len(self.keys) and len(h) >= SPAN:
            kgrams = grams(h, K)
            prints = winnowed(kgrams, words.first)
            at = np.searchsorted(self.keys, kgrams[prints])
            at[at == len(self.keys)] = 0
            done: dict[tuple[int, int], int] = {}
            for p, a in zip(prints[self.keys[at] == kgrams[prints]].tolist(), at[self.keys[at] == kgrams[prints]].tolist()):
                key, doc = self.keys[a], int(words.doc[p])
                low, high = int(words.first[doc]), int(words.first[doc + 1])
                while a < len(self.keys) and self.keys[a] == key:
                    q = int(self.places[a])
                    a += 1
                    item = int(self.item[q])
                    if done.get((item, p - q), -1) > p:
                        continue  # inside a run that was already extended
                    i_low, i_high = int(self.first[item]), int(self.first[item + 1])
                    back, ahead = min(p - low, q - i_low), min(high - p, i_high - q)
                    left = _run(h[p - back : p][::-1], self.hash[q - back : q][::-1])
                    right = _run(h[p : p + ahead], self.hash[q : q + ahead])
                    done[item, p - q] = p + right
                    if left + right >= SPAN:
                        found.append((doc, p - left, p + right, item))
        for n, index in self.short.items():
            keys, own = self.short_keys[n], grams(h, n)
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            for p in np.flatnonzero((keys[at] == own) & words.whole(n)).tolist():
                for item in index[int(own[p])]:
                    i = int(self.first[item])
                    if np.array_equal(h[p : p + n], self.hash[i : i + n]):
                        found.append((int(words.doc[p]), p, p + n, item))
        return found


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Words that are equal from the front."""
    differ = np.flatnonzero(a != b)
    return int(differ[0]) if len(differ) else len(a)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes``, by a hash of the item, each item in one block."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)] if n > 1 else [items]


def contaminated_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (sorted as strings) and ``contaminated`` for each document.

    Every whole text is held against every item; null texts and items have no
    words, items without words and null item ids match nothing. Repeated rows of
    either table are treated alike, very long texts are whole. An empty table gives no
    rows. The benchmark is a stated query set: it goes to the tasks in blocks of
    bounded size, each in its own pass, so that neither it nor the corpus has to
    fit anywhere. With one block nothing is shuffled. With more, the rows are
    numbered and written once, each block's hits are written, and the hits, not
    the texts, are grouped by number.
    """
    narrow = ids_and_texts(docs, id_col, text_col)
    blocks = _blocks(_items(benchmark, item_col, item_text_col), block_bytes)
    if len(blocks) == 1:
        return _apply(narrow, blocks[0], finish=True)
    numbered, numbered_path = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    # One after the other: the driver and each task hold one block at a time.
    parts = [stored(_apply(numbered, b, finish=False), "decontaminate-hits") for b in blocks]
    runs = parts[0][0]
    for more, _ in parts[1:]:
        runs = runs.unionByName(more)
    grouped = runs.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    covered = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(r["b"] - F.greatest(r["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], r["b"]).alias("end")),
    )["n"]
    remove(docs.sparkSession, numbered_path)
    return grouped.select("doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string"))).alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with all of their columns.

    Null and empty texts have no words and stay; repeated rows stay or go together; an
    empty benchmark leaves all rows; extra columns may have any name. Each block of
    the benchmark is one narrow pass over what the blocks before it left, so no
    text moves between machines; between two blocks the rows are written.
    """
    blocks = _blocks(_items(benchmark, item_col, item_text_col), block_bytes)
    out, before = docs, None
    for i, block in enumerate(blocks):
        out = _without(out, block, text_col)
        if i + 1 < len(blocks):
            out, path = stored(out, "decontaminate-left")
            remove(docs.sparkSession, before)
            before = path
    return out


def _sent(block: DataFrame):
    rows = [(r["item_id"], r["text"].encode()) for r in block.collect()]  # bounded by block_bytes
    return block.sparkSession.sparkContext.broadcast(rows)


def _without(docs: DataFrame, block: DataFrame, text_col: str) -> DataFrame:
    sent, at = _sent(block), docs.columns.index(text_col)

    def make():
        index = Block(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit = np.zeros(batch.num_rows, bool)
            hit[[found[0] for found in index.search(Words(text_bytes(batch.column(at)), FOLDED))]] = True
            return batch.filter(pa.array(~hit))

        return step

    return arrow_map(docs, docs.schema, make, column=at)


def _apply(narrow: DataFrame, block: DataFrame, finish: bool) -> DataFrame:
    sent = _sent(block)

    def make():
        index = Block(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(text_bytes(batch.column(1)), FOLDED)
            by_doc: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for doc, a, b, item in index.search(words):
                by_doc[doc].append((a - int(words.first[doc]), b - int(words.first[doc]), index.ids[item]))
            n_words = np.diff(words.first)
            n = batch.num_rows
            if not finish:
                runs = [[{"a": a, "b": b} for a, b, _ in by_doc.get(i, ())] for i in range(n)]
                ids = [sorted({i for _, _, i in by_doc.get(d, ())}) for d in range(n)]
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "runs", "items"])
            hit = np.zeros(n, np.int64)
            named: list[list[str]] = [[] for _ in range(n)]
            for doc, found in by_doc.items():
                mask = np.zeros(int(n_words[doc]), bool)
                for a, b, _ in found:
                    mask[a:b] = True
                hit[doc] = int(mask.sum())
                named[doc] = sorted({str(i) for _, _, i in found})
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hit), pa.array(named, pa.list_(pa.string())), pa.array(hit > 0)], names=["doc_id", "n_words", "n_hit", "items", "contaminated"])

        return step

    schema = "doc_id long, n_words long, n_hit long, items array<string>, contaminated boolean" if finish else "doc_id long, row long, n_words long, runs array<struct<a:long,b:long>>, items array<long>"
    return arrow_map(narrow, schema, make)
