"""Cached encoding with the public tokenizers.

A text is cut where the tokenizer always cuts too, each different unit is encoded
once by the library and kept in a bounded cache, and the ids of a text are those of
its units in order. For ``tokenizers`` files the units of a text are found, hashed
and looked up in whole-array steps over its bytes:

* white space in front of a word, but for the one space that a byte-level pre-token
  takes in (with word ends white space is dropped);
* the letters that a word starts with, where what follows them is an ASCII byte that
  is no letter: there the pre-token that takes letters ends;
* the rest of the word.

The rules are those of GPT-2's and CLIP's patterns. A file for which a probe text has
other ids than the library gives is encoded whole, and so are texts with other
white space or special strings.

Piece BPE: spaces become U+2581, which the vocabulary has only at the front of a
piece, so no merge crosses such a place and a text is cut in front of its spaces.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from granary.llm.common import prefix_hashes, span_hashes

#: Units in a table, and ids that it holds, in one Python worker; then it starts anew.
TABLE_BITS, TABLE_IDS = 21, 6_000_000
#: Bytes of text that are looked up at once. Longer texts are cut in front of white space.
PIECE_BYTES = 1 << 20
#: Segments in each of a piece cache's two generations, in one Python worker.
CACHE_SEGMENTS = 600_000
#: Longer segments are encoded anew in each batch, so that the cache's bytes are bounded too.
CACHE_CHARS = 64

#: A lone surrogate, which no text from Arrow holds, in front of a segment that stands for just itself.
_MARK = "\ud800"
_SPACES = re.compile("[ ▁]+[^ ▁]*")

#: White space on which libraries may differ, and NUL; and bytes that may start such a character (U+0085, 00A0, 1680, 180E, 2000-200F, 2028, 2029, 202F, 205F, 2060, 3000, FEFF).
_ODD = np.array([b in (0, 9, 11, 12, 13, 28, 29, 30, 31) for b in range(256)])
_ODD_LEAD = np.array([b in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF) for b in range(256)])
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Forms of a unit: by itself, after one space; white space in front of a word, in front of a space and a word, at the end.
_BARE, _SPACED, _FRONT, _FRONT_SPACED, _END = range(5)
_PROBE = (
    "Probe a text, it's don't we'll I'VE: ab12 12ab 3.14 (x) [y]... foo_bar--baz can't!  two   three\nline\n\n\nlast \n mixed \nend of été Ärger Straße, ĂčŰ ñandú; naïve.5 o'clock' 'tis ''re x's. 东京都 abc东 áb “q” ¿cómo? $$$ ***word &&& a",
    " front", "\nfront", "end ", "end\n\n", "  ", "\n", "A", "one.", "'s", "x" * 70 + " " + "é" * 40 + "," * 90,
)


# The characters that byte-level vocabularies have for bytes that aren't printable in Latin-1.
_BYTE_CHARACTERS = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Generations:
    """A bounded map: when the young generation is full, it becomes the old one."""

    def __init__(self, bound: int):
        self.bound, self.young, self.old = bound, {}, {}

    def unknown(self, segments: set[str]) -> set[str]:
        """Those that ``young`` lacks after it took over what ``old`` has."""
        missing = segments.difference(self.young)
        if missing and self.old:
            kept = [s for s in missing if s in self.old]
            self.young.update((s, self.old[s]) for s in kept)
            missing.difference_update(kept)
        return missing

    def trim(self, new: set[str]) -> None:
        for s in [s for s in new if len(s) > CACHE_CHARS]:
            self.young.pop(s, None)
        if len(self.young) > self.bound:
            self.young, self.old = {}, self.young


class _Table:
    """An open-addressed map from 64-bit hashes to ids, which lie in one flat array."""

    def __init__(self, bits: int = TABLE_BITS, ids: int = TABLE_IDS):
        self.bits, self.most_ids = bits, ids
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)  # 0: free
        self.at = np.zeros(1 << self.bits, np.int64)  # start in ids, and their number in the low 24 bits
        self.ids, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0

    def full(self, units: int) -> bool:
        return self.n + units > (5 << self.bits) // 8 or self.used > self.most_ids

    def find(self, keys: np.ndarray) -> np.ndarray:
        """What ``at`` has for each key, -1 for unknown ones."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """``keys`` are different and unknown."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            grown = np.zeros(2 * (self.used + total), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(ids)
        value = (self.used + np.cumsum(sizes) - sizes) << 24 | sizes
        self.used += total
        self.n += len(keys)
        slot, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.at[slot[won]] = value[won]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def gather(self, found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all that was found, and how many there are up to each of ``bounds``."""
        sizes = found & 0xFFFFFF
        to = np.concatenate(([0], np.cumsum(sizes)))
        if not to[-1]:
            return np.zeros(0, np.uint32), to[bounds]
        some = np.flatnonzero(sizes)
        return self.ids[np.repeat((found[some] >> 24) - to[some], sizes[some]) + np.arange(to[-1])], to[bounds]


def _odd_places(raw: np.ndarray) -> np.ndarray:
    """Places of white space other than spaces and line ends, and of NUL."""
    at = np.flatnonzero(raw >= 0xC2)
    at = at[_ODD_LEAD[raw[at]]]
    wide = np.concatenate((raw, np.zeros(2, np.uint8)))
    lead, b, c = raw[at], wide[at + 1], wide[at + 2]
    bad = (lead == 0xC2) & ((b == 0x85) | (b == 0xA0))
    bad |= (lead == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    bad |= (lead == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & ((c == 0x9F) | (c == 0xA0))))
    bad |= ((lead == 0xE3) & (b == 0x80) & (c == 0x80)) | ((lead == 0xEF) & (b == 0xBB) & (c == 0xBF))
    low = np.flatnonzero(raw < 32)
    return np.concatenate((low[_ODD[raw[low]]], at[bad]))


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and the letters of U+00C0 to U+024F, but for U+0130, which is a letter and a mark in lower case."""
    out = ((raw | np.uint8(32)) - np.uint8(97)) < 26
    lead = np.flatnonzero((raw - np.uint8(0xC3)) < 7)
    if len(lead):
        after = raw[lead + 1]  # a lead is never the last byte
        good = ((raw[lead] == 0xC3) & (after != 0x97) & (after != 0xB7)) | ((raw[lead] > 0xC3) & ((raw[lead] < 0xC9) | (after < 0x90)))
        good = lead[good & ((raw[lead] != 0xC4) | (after != 0xB0))]
        out[good] = True
        out[good + 1] = True
    return out


def _pieces(text: bytes) -> list[bytes]:
    """A long text in parts that are cut in front of white space."""
    out, at = [], 0
    while len(text) - at > PIECE_BYTES:
        cut = at + PIECE_BYTES
        while cut < len(text) and not (text[cut] in (10, 32) and text[cut - 1] not in (10, 32)):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) or not out else out


class JsonTokenizer:
    """A ``tokenizers`` file, add_special_tokens=False, special strings as the library has them."""

    def __init__(self, path: str, bits: int = TABLE_BITS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self._tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        #: Texts with one of these stay whole.
        self._special = [a.content.encode() for a in t.get_added_tokens_decoder().values()]
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        self.vocabulary = len(names)
        self._ends = any(x.endswith("</w>") for x in names[:5000])
        self._model = t.model
        self._table = _Table(bits)
        self._whole = False
        probes = [p.encode() for p in _PROBE]
        self._whole = any(not np.array_equal(a, b) for a, b in zip(self.encode(probes), self._library(probes), strict=True))

    def _library(self, texts: list[bytes]) -> list[np.ndarray]:
        said = [t.decode() for t in texts]
        return [np.asarray(e.ids, "<u4") for at in range(0, len(said), 1000) for e in self._tokenizer.encode_batch_fast(said[at : at + 1000], add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (UTF-8)."""
        if self._whole:
            return self._library(texts)
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            if size + len(text) > PIECE_BYTES and held:
                out += self._encode(held)
                held, size = [], 0
            if len(text) > PIECE_BYTES:
                odd = len(_odd_places(np.frombuffer(text, np.uint8))) or any(s in text for s in self._special)
                out.append(self._library([text])[0] if odd else np.concatenate([x for p in _pieces(text) for x in self._encode([p])]))
                continue
            held.append(text)
            size += len(text)
        return out + self._encode(held) if held else out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b" ".join(texts) + b" "
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        raw = np.frombuffer(joined, np.uint8)
        odd = set(np.searchsorted(bounds, _odd_places(raw), "right") - 1)
        for s in self._special:
            at = joined.find(s)
            while at >= 0:
                odd.add(int(np.searchsorted(bounds, at, "right")) - 1)
                at = joined.find(s, at + 1)
        if self._ends:
            joined = joined.translate(_SMALL)
            raw = np.frombuffer(joined, np.uint8)
        ids, ends = self._units(joined, raw, bounds)
        if not self._ends:
            # A text of white space alone has no word to carry it.
            odd |= {i for i in np.flatnonzero((np.diff(ends, prepend=0) == 0) & (np.diff(bounds) > 1)).tolist()}
        at = [0, *ends.tolist()]
        out = [ids[a:b] for a, b in zip(at, at[1:])]
        if odd:
            order = sorted(odd)
            for i, x in zip(order, self._library([texts[i] for i in order]), strict=True):
                out[i] = x
        return out

    def _units(self, joined: bytes, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text end."""
        white = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        edge = edge if white[0] else np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        first = np.searchsorted(start, bounds)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        # The letters that a word starts with: runs of letters after white space.
        letter = _letters(raw)
        change = letter[1:] != letter[:-1]
        runs = np.flatnonzero(change) + 1
        runs = np.concatenate(([0], runs)) if letter[0] else runs
        run_start, run_end = runs[0::2], runs[1::2]
        fresh = white[run_start - 1]
        fresh[:1] |= run_start[:1] == 0
        led, stop = np.flatnonzero(letter[start]), run_end[fresh]
        cut = start.copy()
        fine = raw[stop] < 128  # a word ends at white space, which is one
        cut[led[fine]] = stop[fine]
        sums = prefix_hashes(raw)
        asked: list[tuple] = []

        def ask(column: int, at: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray | int) -> None:
            keys = span_hashes(sums, a, b, form)
            asked.append((column, at, a, b, np.broadcast_to(np.asarray(form, np.uint64), len(at)), keys, self._table.find(keys)))

        if self._ends:
            spaced = np.zeros(len(start), np.uint64)
        else:
            before = np.concatenate(([0], end[:-1]))
            some = np.flatnonzero(np.diff(first))
            before[first[:-1][some]] = bounds[:-1][some]
            gap = start - before
            spaced = ((gap > 0) & (raw[start - 1] == 32)).astype(np.uint64)
            front = np.flatnonzero(gap > spaced)
            ask(0, front, before[front], start[front] - spaced[front].astype(np.int64), _FRONT + spaced[front])
            last = first[1:][some] - 1
            stop = bounds[1:][some] - 1
            tail = end[last] < stop
            ask(3, last[tail], end[last[tail]], stop[tail], _END)
        led = np.flatnonzero(cut > start)
        ask(1, led, start[led], cut[led], spaced[led])
        rest = np.flatnonzero(cut < end)
        ask(2, rest, cut[rest], end[rest], np.where(cut[rest] > start[rest], 0, spaced[rest]).astype(np.uint64))
        lost = [np.flatnonzero(x[6] < 0) for x in asked]
        if units := sum(map(len, lost)):
            if self._table.full(units):
                self._table.clear()
                lost = [np.arange(len(x[1])) for x in asked]
            self._learn(joined, [(x[2][m], x[3][m], x[4][m], x[5][m], x[0] == 1) for x, m in zip(asked, lost, strict=True)])
            for x, m in zip(asked, lost, strict=True):
                x[6][m] = self._table.find(x[5][m])
        # A row for each word; 0 stands for no unit, as it has no ids.
        found = np.zeros((len(start), 4), np.int64)
        for x in asked:
            found[x[1], x[0]] = x[6]
        return self._table.gather(found.reshape(-1), 4 * first[1:])

    def _learn(self, joined: bytes, lost: list[tuple]) -> None:
        keys = np.concatenate([x[3] for x in lost])
        keys, at = np.unique(keys, return_index=True)
        a, b, form = (np.concatenate([x[i] for x in lost])[at].tolist() for i in range(3))
        letters = np.concatenate([np.full(len(x[0]), x[4]) for x in lost])[at]
        plain = np.flatnonzero(letters & ((np.array(form) == _SPACED) | self._ends)).tolist()
        out: list[np.ndarray | None] = [None] * len(keys)
        for place, ids in zip(plain, self._plain([joined[a[i] : b[i]] for i in plain]), strict=True):
            out[place] = ids
        other = [i for i, x in enumerate(out) if x is None]
        # White space in front is encoded before a word of one id, which is then dropped.
        around = {_BARE: (b"", b""), _SPACED: (b" ", b""), _FRONT: (b"", b"a"), _FRONT_SPACED: (b"", b" a"), _END: (b"", b"")}
        said = [around[form[i]][0] + joined[a[i] : b[i]] + around[form[i]][1] for i in other]
        for i, ids in zip(other, self._library(said), strict=True):
            out[i] = ids[:-1] if around[form[i]][1] else ids
        self._table.add(keys, out)

    def _plain(self, words: list[bytes]) -> list[np.ndarray]:
        """Words of plain letters, each one pre-token: what the library's model makes of their byte characters."""
        tokenize, head = self._model.tokenize, "" if self._ends else "Ġ"
        said = [w.decode().lower() for w in words] if self._ends else [w.decode() for w in words]
        return [np.array([t.id for t in tokenize(head + (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARACTERS)))], "<u4") for w in said]


def space_segments(text: str) -> list[str]:
    """Segments of a text for the piece model, each without the space that the model adds or reads in front."""
    return [s[1:] for s in _SPACES.findall(" " + text)] if text else []


class PieceTokenizer:
    """A ``sentencepiece`` model without begin, end or added tokens; counts only."""

    def __init__(self, path: str, bound: int = CACHE_SEGMENTS):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        #: A piece with white space inside would cross a cut: then texts stay whole.
        self._uncut = any("▁" in p.lstrip("▁") for p in pieces)
        self._lines = not any("\n" in p for p in pieces) and m.encode("a\nb", out_type=str)[:1] == m.encode("a", out_type=str)
        #: A single space at the end has nothing left when its front space is taken off.
        self._lone = len(m.encode("a ")) - len(m.encode("a"))
        #: What the model reads in front of a line end at the start of a segment.
        self._front = len(m.encode("\nb")) - (len(m.encode("a\nb")) - len(m.encode("a")))
        self._cache = _Generations(bound)
        self._prefixes: PrefixPieces | None = None

    def count_segments(self, segments: list[str]) -> list[int]:
        """Tokens of each segment of :func:`space_segments`."""
        used = set(segments)
        self._learn(used)
        out = list(map(self._cache.young.__getitem__, segments))
        self._cache.trim(used)
        return out

    def _learn(self, used: set[str]) -> None:
        new = list(self._cache.unknown(used))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            ids = self._model.encode([s[1:] if s[:1] == _MARK else s for s in part], num_threads=1)
            # _MARK:  a line end with no space in front; "" is a lone space
            self._cache.young.update((s, (len(x) - self._front if s[:1] == _MARK else len(x)) if s else self._lone) for s, x in zip(part, ids, strict=True))

    def _parts(self, text: str) -> list[str]:
        if self._lines and "▁" not in text:
            parts = text.replace("\n", f" {_MARK}\n").split(" ")
            if "" not in parts:
                return parts
        return space_segments(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        if self._uncut:
            return [len(x) for x in self._model.encode(texts, num_threads=1)]
        cut = [self._parts(t) if t else [] for t in texts]
        used = set(chain.from_iterable(cut))
        self._learn(used)
        get = self._cache.young.__getitem__
        out = [sum(map(get, parts)) for parts in cut]
        self._cache.trim(used)
        return out

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment of :func:`space_segments`, from the empty one (its space alone) to the whole."""
        if len(segment) <= CACHE_CHARS:
            return self.count_segments([segment[:i] for i in range(len(segment) + 1)])
        if self._prefixes is None:
            self._prefixes = PrefixPieces(self._model)
        return self._prefixes.counts(segment)

    def ids(self, text: str) -> list[int]:
        return self._model.encode(text)


class PrefixPieces:
    """Token counts at all prefixes of one segment by dynamic programming, without encoding them.

    In byte pair encoding the encoding of a text without its last token is that
    of the shorter text, and a token can follow another exactly if the two
    together are encoded as those two. So the last token at each place is the one
    that can follow the last token where it starts, and its count is one more
    than there: at most as many look-ups for a character as a piece is long.
    Characters that aren't in the vocabulary are as many tokens as bytes.
    """

    #: Known pairs of tokens that are kept.
    PAIRS = 500_000

    def __init__(self, model):
        odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
        self._model = model
        self._score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not odd(i)}
        self._longest = max(map(len, self._score))
        self._follows: dict[tuple[str, str], bool] = {}

    def _encode(self, text: str) -> list[str]:
        """Best score first, the leftmost of equal ones; for short texts."""
        parts, score = list(text), self._score
        while True:
            joined = [(-score[x], i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in score]
            if not joined:
                return parts
            at = min(joined)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _can_follow(self, before: str, token: str) -> bool:
        known = self._follows.get((before, token))
        if known is None:
            if len(self._follows) >= self.PAIRS:
                self._follows.clear()
            known = self._follows[before, token] = self._encode(before + token) == ([before, token] if before else [token])
        return known

    def counts(self, segment: str) -> list[int]:
        """As the library counts ``segment[:i]`` for each ``i``; what it finds is checked at some places."""
        text = "▁" + segment.replace(" ", "▁")
        known, longest, can = self._score, self._longest, self._can_follow
        out, last = [0], [""]
        for end in range(1, len(text) + 1):
            if text[end - 1] not in known:
                out.append(out[-1] + len(text[end - 1].encode()))
                last.append("")
                continue
            for size in range(1, min(longest, end) + 1):
                token = text[end - size : end]
                if token in known and can(last[end - size], token):
                    out.append(out[end - size] + 1)
                    last.append(token)
                    break
            else:
                return self._slowly(segment)
        n = len(segment)
        if any(len(self._model.encode(segment[:i])) != out[i + 1] for i in {n * k // 8 for k in range(1, 9)} - {0}):
            return self._slowly(segment)
        return out[1:]

    def _slowly(self, segment: str) -> list[int]:
        """For a model that isn't of this form: each prefix by itself, one held at a time."""
        lone = len(self._model.encode("a ")) - len(self._model.encode("a"))
        return [lone] + [len(self._model.encode(segment[:i])) for i in range(1, len(segment) + 1)]


_LOADED: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One tokenizer for each Python worker, with its cache, whatever the number of tasks it runs."""
    return _LOADED.setdefault((kind, path), None) or _LOADED.update({(kind, path): kind(path)}) or _LOADED[kind, path]
