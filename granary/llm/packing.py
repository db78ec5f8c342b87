"""Sequence packing by Karmarkar-Karp multiway differencing.

A partition of the documents is packed without a shuffle, in batches of a
bounded number of ids. Of each document, full sequences are cut off first; the
rests are dealt to windows by multiway differencing: every rest starts as a
partial partition with one filled window, and the two partial partitions of the
largest spread are merged, fullest window onto emptiest, until one is left. The
window count starts at the least that can hold all ids and rises whenever a
window exceeds the capacity. Then the near-equal windows are levelled by cutting
(cuts are free): the last windows fill up the others, so that only their documents
are cut. What is left, less than a sequence, goes into the next batch; that of a
task's last batch is laid out in power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from granary.llm.common import bounded_batches, give_back, ids_and_texts, sliced, text_bytes
from granary.llm.tokens import JsonTokenizer, loaded

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids gathered before they are packed: about 128 windows of 4096.
BATCH_IDS = 1 << 19


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for ``k`` windows: the indices in each window, near-equal in sum.

    A partial partition is kept as its windows in descending order of sum; the
    spread between the first and the last decides which two are merged next.
    Windows that are still empty aren't stored, so the work follows the rests.
    """
    if k <= 0:
        return []
    # Windows are (-sum, indices), so that ascending order has the largest first.
    heap = [(-size, i, [(-size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    load = itemgetter(0)
    while len(heap) > 1:
        _, order, a = heapq.heappop(heap)
        _, _, b = heap[0]
        # The smallest windows of one meet the largest of the other; empty ones are the smallest.
        alone, room = max(0, k - len(b)), max(0, k - len(a))
        merged = a[:alone] + b[:room] + [(x + y, xs + ys) for (x, xs), (y, ys) in zip(reversed(a[alone:]), b[room:])]
        merged.sort(key=load)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heapreplace(heap, (spread, order, merged))
    windows = [items for _, items in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def windows_within(sizes: list[int], capacity: int) -> list[list[int]]:
    """Differencing into the fewest windows, from the least count upwards, that all hold at most ``capacity``.

    Every size is at most ``capacity``. The count rises by the share of windows
    that were exceeded, at least by one, so few rounds are needed.
    """
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, k)
        over = sum(sum(sizes[i] for i in w) > capacity for w in found)
        if not over:
            return [w for w in found if w]
        k += max(1, over // 4)


Piece = tuple[int, int, int]


def level(windows: list[list[Piece]], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of pieces ``(document, start, length)``, and the pieces that are left: less than a sequence.

    Windows are filled in turn from the end of the list. So the documents of the
    near-equal windows stay whole and only those of the last ones are cut.
    """
    windows = [list(w) for w in windows]
    loads = [sum(p[2] for p in w) for w in windows]
    out, last = [], len(windows) - 1
    i = 0
    while i < last:
        while loads[i] < capacity and i < last:
            doc, start, length = windows[last].pop()
            take = min(length, capacity - loads[i])
            # The front of the piece moves on, its end stays behind.
            windows[i].append((doc, start, take))
            if take < length:
                windows[last].append((doc, start + take, length - take))
            loads[i] += take
            loads[last] -= take
            if not loads[last]:
                last -= 1
        if loads[i] == capacity:
            out.append(windows[i])
            i += 1
    if i > last or not windows:
        return out, []
    return (out, windows[i]) if loads[i] < capacity else ([*out, windows[i]], [])


def tails(rest: list[Piece]) -> list[list[Piece]]:
    """``rest`` in sequences of power-of-two lengths in descending order, which need no padding."""
    rest, left, out = rest[::-1], sum(p[2] for p in rest), []
    while left:
        sequence, room = [], 1 << (left.bit_length() - 1)
        left -= room
        while room:
            doc, start, length = rest.pop()
            take = min(length, room)
            sequence.append((doc, start, take))
            if take < length:
                rest.append((doc, start + take, length - take))
            room -= take
        out.append(sequence)
    return out


def full_sequences(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of pieces ``(index, start, length)`` of the ``sizes`` ids, and the pieces that are left."""
    full, rests = [], []
    for i, size in enumerate(sizes):
        whole = size // capacity * capacity
        full += [[(i, at, capacity)] for at in range(0, whole, capacity)]
        if size > whole:
            rests.append((i, whole, size - whole))
    dealt = windows_within([r[2] for r in rests], capacity)
    more, left = level([[rests[j] for j in w] for w in dealt], capacity)
    return full + more, left


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of pieces ``(index, start, length)`` that hold each of the ``sizes`` ids once."""
    full, left = full_sequences(sizes, capacity)
    return full + tails(left)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, capacity: int = CAPACITY, batch_ids: int = BATCH_IDS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    Columns: ``doc_id, start`` (ids of the document before the piece), ``length,
    ids_crc32`` (of the piece's ids as little-endian unsigned 32-bit), ``doc_tokens``
    (with the end id), ``sequence_id, offset`` (in the sequence, gapless from 0);
    ``with_ids`` adds ``ids``, the piece's ids.

    A null or empty text is its end id alone. Repeated rows and null ids are
    documents of their own. An empty table gives no rows. Nothing is shuffled: a
    task packs what it reads, in batches of ``batch_ids`` ids, so memory is bounded
    by a batch and the longest document, and a lost task gives the same rows again.
    A task's last sequences have power-of-two lengths; no sequence is padded.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4")

    def run(batches):
        tokenizer = loaded(JsonTokenizer, tokenizer_file)
        sequence = TaskContext.get().partitionId() << 32
        # Document, where these ids start in it, the ids, the number of all its ids.
        held: list[tuple[int | None, int, np.ndarray, int]] = []
        count = 0

        def flush(finish: bool) -> pa.RecordBatch:
            nonlocal sequence, held, count
            rows: list[list] = [[] for _ in range(8)]
            full, left = full_sequences([len(x[2]) for x in held], capacity)
            for pieces in full + tails(left) if finish else full:
                offset = 0
                for i, start, length in pieces:
                    doc, before, ids, total = held[i]
                    part = ids[start : start + length]
                    for column, value in zip(rows, (doc, before + start, length, zlib.crc32(part), total, sequence, offset, part.view("<i4") if with_ids else None), strict=True):
                        column.append(value)
                    offset += length
                sequence += 1
            held = [] if finish else [(held[i][0], held[i][1] + start, held[i][2][start : start + length].copy(), held[i][3]) for i, start, length in left]
            count = sum(len(x[2]) for x in held)
            arrays = [pa.array(c, pa.int64()) for c in rows[:7]] + ([pa.array(rows[7], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in sliced(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(text_bytes(batch.column(1))), strict=True):
                held.append((doc, 0, np.concatenate((ids, end)), len(ids) + 1))
                count += len(ids) + 1
                if count >= batch_ids:
                    yield flush(False)
        if held:
            yield flush(True)
        give_back()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>" * with_ids
    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, schema)
