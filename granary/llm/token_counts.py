"""Token counts with exact prefixes.

The count of a prefix is a dynamic program over the text: tokens of all segments
before it (no merge crosses a segment's front, see :mod:`granary.llm.tokens`)
plus the tokens of the part of its own segment. Those are found once for each
different short segment and kept; in a long one (a text without spaces) they are
a dynamic program themselves, over the pieces (:class:`granary.llm.tokens.PrefixPieces`),
in time and memory proportional to its length. After that, truncation and budget questions are
look-ups: nothing is encoded again.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import arrow_map, ids_and_texts
from granary.llm.tokens import PieceTokenizer, loaded, space_segments

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


class PrefixCounts:
    """``counts[p]`` is the exact number of tokens of the first ``p`` code points of ``text``."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, chars: int) -> int:
        return int(self.counts[min(max(chars, 0), len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens.

        Counts aren't monotone (a longer prefix can merge into fewer tokens), so
        the largest such prefix is taken, not the first that is over.
        """
        return int(np.flatnonzero(self.counts <= budget)[-1]) if budget >= 0 else 0


class PrefixCounter:
    """Builds :class:`PrefixCounts`; prefix counts inside a segment are kept for each different segment."""

    def __init__(self, tokenizer: PieceTokenizer, bound: int = 50_000):
        self._tokenizer, self._bound, self._inside = tokenizer, bound, {}

    def _within(self, segment: str) -> list[int]:
        """Tokens of the segment's space alone, and then with each further code point."""
        known = self._inside.get(segment)
        if known is None:
            known = self._tokenizer.prefix_counts(segment)
            if len(segment) <= 64:
                if len(self._inside) >= self._bound:
                    self._inside.clear()
                self._inside[segment] = known
        return known

    def prefixes(self, text: str) -> PrefixCounts:
        counts, before = [0], 0
        for i, segment in enumerate(space_segments(text)):
            within = self._within(segment)
            # The first segment's space is the one that the model puts in front of a text.
            counts += [before + n for n in (within[1:] if i == 0 else within)]
            before += within[-1]
        return PrefixCounts(np.asarray(counts, np.int32))

    def longest(self, text: str, budget: int) -> tuple[int, int]:
        """Code points and tokens of the longest prefix of at most ``budget`` tokens, as :meth:`PrefixCounts.longest` finds it.

        A segment's prefixes have at least one token more than all before it, so
        that prefix ends in the last segment with room for one: only its table is made.
        """
        segments = space_segments(text)
        before = np.concatenate(([0], np.cumsum(self._tokenizer.count_segments(segments), dtype=np.int64)))
        if budget < 1 or not segments:
            return 0, 0
        last = min(int(np.searchsorted(before, budget, "left")), len(segments)) - 1
        within = self._within(segments[last])
        inside = max(i for i, n in enumerate(within) if before[last] + n <= budget)
        # The first segment's space is the one that the model puts in front of a text: alone it is no prefix.
        chars = sum(map(len, segments[:last])) + last + inside
        return chars, int(before[last] + within[inside]) if chars else 0


def _counter(tokenizer_file: str) -> PrefixCounter:
    return PrefixCounter(loaded(PieceTokenizer, tokenizer_file))


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, limit_chars`` of every whole text.

    ``limit_chars`` are the code points of its longest prefix of at most ``limit``
    tokens: the whole text, or where it is over the limit by the prefix table of
    the segment that reaches it. One row for each input row, repeated rows included; a null text counts as
    empty (0 bytes, 0 tokens), a null id stays null. Only the id and text columns
    are read. One narrow pass: no shuffle, memory bounded by a batch of texts and
    the segment cache.
    """
    def make():
        tokenizer, counter = loaded(PieceTokenizer, tokenizer_file), _counter(tokenizer_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = tokenizer.count(texts)
            chars = [counter.longest(t, limit)[0] if n > limit else len(t) for t, n in zip(texts, counts, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(chars, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

        return step

    return arrow_map(ids_and_texts(docs, id_col, text_col), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long", make)


def prefix_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, prefix_tokens``: for each text the exact token count at every code point prefix (entry 0 is 0).

    Null and empty texts give ``[0]``. The arrays are as long as the texts; use
    :func:`truncate_to_budget` where only an answer is needed.
    """
    def make():
        counter = _counter(tokenizer_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [counter.prefixes(t or "").counts for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

        return step

    return arrow_map(ids_and_texts(docs, id_col, text_col), "doc_id long, prefix_tokens array<int>", make)


def truncate_to_budget(docs: DataFrame, tokenizer_file: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_tokens``: the longest prefix of each text with at most ``budget`` tokens.

    One row for each input row. Null and empty texts give an empty text of 0 tokens, as
    does a budget below 1; null ids stay null, repeated rows are cut alike. Very long
    texts are cut by the table of the one segment that reaches the budget.
    """
    def make():
        counter = _counter(tokenizer_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                chars, n = counter.longest(text or "", budget)
                texts.append((text or "")[:chars])
                counts.append(n)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_tokens"])

        return step

    return arrow_map(ids_and_texts(docs, id_col, text_col), "doc_id long, text string, n_tokens long", make)
