"""Text of positioned items: lines, word gaps, and two-column pages in reading order.

The items of a page meet in one row (an array sorted in the JVM). The pages of an Arrow
batch are laid out together in whole-array steps; :func:`page_text` is the same rule for one page, and
serves those whose items begin or end in white space other than spaces. A page's items are bounded by the page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.workspace import bounded_batches

SAME_LINE = 3.0
#: Lines times places of a gutter that are held at once; a larger page is held by itself.
CELLS = 4_000_000
_LETTERS_AT_END = regex.compile(r"\p{L}+$")
_LETTERS_AT_FRONT = regex.compile(r"^\p{L}+")


@dataclass(frozen=True)
class Item:
    x: float
    y: float
    width: float
    height: float
    text: str
    raw: str

    @property
    def right(self) -> float:
        return self.x + self.width

    @property
    def glyph(self) -> float:
        return self.width / len(self.text)


Line = list[Item]


def lines_of(items: list[Item]) -> list[Line]:
    """Items by line: each joins the line that began within three units of its height; going down, that is the last one."""
    lines: list[Line] = []
    head = None
    for item in sorted(items, key=lambda i: (i.y, i.x)):
        if head is not None and abs(head - item.y) <= SAME_LINE:
            lines[-1].append(item)
        else:
            head = item.y
            lines.append([item])
    return [sorted(line, key=lambda i: i.x) for line in lines]


def _gap(line: str, left: Item, right: Item) -> str:
    """What stands between two items: a tab over a wide gap, a space between words, nothing inside one."""
    gap = right.x - left.right
    if gap > max(12.0, 1.5 * left.height):
        return "\t"
    size, glyph = max(left.height, right.height, 1.0), max(min(left.glyph, right.glyph), 0.5)
    encoded = left.raw[-1:].isspace() or right.raw[:1].isspace()
    letters = sum(len(m[0]) for m in (_LETTERS_AT_END.search(line), _LETTERS_AT_FRONT.search(right.text)) if m)
    return " " if encoded or gap > min(0.1 * size, 0.2 * glyph) or gap < -0.5 * glyph or letters > 24 else ""


def line_text(line: Line) -> str:
    """The line's text; a copy of the last item drawn within two units (fake bold) is passed over."""
    text, last = "", None
    for item in line:
        if last is not None:
            if item.text == last.text and abs(item.x - last.x) <= 2:
                continue
            text += _gap(text, last, item)
        text, last = text + item.text, item
    return text


def simple_line_text(line: Line) -> str:
    """The screening's rendering: a tab over a wide gap, else a space."""
    out = line[0].text
    for left, right in zip(line, line[1:]):
        out += ("\t" if right.x - left.right > max(12.0, 1.5 * left.height) else " ") + right.text
    return out


def bands(lines: list[Line], x: float) -> list[tuple[bool, list[Line]]]:
    """Runs of lines that leave ``x`` free; each line that crosses it is a run of its own, marked."""
    out: list[tuple[bool, list[Line]]] = []
    for line in lines:
        crosses = any(i.x < x - 1 and i.right > x + 1 for i in line)
        if crosses or not out or out[-1][0]:
            out.append((crosses, [line]))
        else:
            out[-1][1].append(line)
    return out


def sides(lines: list[Line], x: float) -> tuple[list[Line], list[Line]] | None:
    """Left and right lines of a band, where both read like prose: four lines, five words each on the mean."""
    parts = tuple([part for line in lines if (part := [i for i in line if (i.x + i.width / 2 < x) == left])] for left in (True, False))
    words = lambda part: sum(len(regex.split(r"\s+", " ".join(i.text for i in line))) for line in part)
    return parts if all(len(p) >= 4 and words(p) / len(p) >= 5 for p in parts) else None


def gutter(lines: list[Line], width: float) -> float | None:
    """Where the columns part: the middle of the first stretch that serves the most lines on both sides."""
    if len(lines) < 8:
        return None
    best, first, last, x = 0, 0.0, 0.0, width * 0.3
    while x <= width * 0.7:
        served = max((min(map(len, s)) for crosses, band in bands(lines, x) if not crosses and (s := sides(band, x))), default=0)
        if served > best:
            best, first, last = served, x, x
        elif served == best and best and x - last <= 2:
            last = x
        x += 2
    return (first + last) / 2 if best else None


def page_text(items: list[Item], width: float, columns: bool = True, render=line_text) -> str:
    """A page's lines in reading order, an empty line where the gap is wide."""
    lines = lines_of(items)
    at = gutter(lines, width) if columns else None
    if at is not None:
        ordered: list[Line] = []
        for crosses, band in bands(lines, at):
            parts = None if crosses else sides(band, at)
            ordered += [*parts[0], *parts[1]] if parts else band
        lines = ordered
    out = []
    for i, line in enumerate(lines):
        apart = i and line[0].y - lines[i - 1][0].y > max(20.0, 1.8 * lines[i - 1][0].height)
        out.append(("\n" if apart else "") + render(line))
    return "\n".join(out)


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ITEM = ("x", "y", "width", "height", "raw")
_SEPARATORS = pa.array(["", " ", "\t", "\n", "\n\n"], pa.large_string())


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _line_numbers(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The line of each item, in order of page and height, as :func:`lines_of` has it."""
    new = np.ones(len(y), bool)
    new[1:] = (page[1:] != page[:-1]) | ~(np.diff(y) <= SAME_LINE)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(y))
    # Items close to the next one are a line, unless together they reach further than a line does.
    for a, b in zip(*(x[y[ends - 1] - y[at] > SAME_LINE].tolist() for x in (at, ends))):
        head = y[a]
        for i in range(a + 1, b):
            if not y[i] - head <= SAME_LINE:
                new[i], head = True, y[i]
    return np.cumsum(new) - 1


def _places(width: float) -> np.ndarray:
    out, x = [], width * 0.3
    while x <= width * 0.7:
        out.append(x)
        x += 2
    return np.array(out)


def _per_line(line: np.ndarray, first: np.ndarray, k: int, lines: int, weight: np.ndarray) -> np.ndarray:
    """Places by lines: the weights of the line's items from their first place on."""
    out = np.bincount(first * lines + line, weight, (k + 1) * lines).reshape(k + 1, lines)
    return np.cumsum(out, axis=0)[:k]


def _served(crosses: np.ndarray, left: np.ndarray, left_words: np.ndarray, n: np.ndarray, words: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a table of places by lines: where bands begin (flat), and on how many lines each serves both sides."""
    new = np.ones(crosses.shape, bool)
    new[:, 1:] = (page[1:] != page[:-1]) | crosses[:, 1:] | crosses[:, :-1]
    at = np.flatnonzero(new.ravel())
    add = lambda values: np.add.reduceat(values.ravel(), at)
    right = n - left
    counts = [add((side > 0).astype(np.int64)) for side in (left, right)]
    sums = [add(side) for side in (left_words, words - left_words)]
    good = ~crosses.ravel()[at]
    for count, total in zip(counts, sums):
        good &= (count >= 4) & (total >= 5 * count)
    return at, np.where(good, np.minimum(*counts), 0)


def _gutters(line: np.ndarray, page: np.ndarray, x: np.ndarray, right: np.ndarray, centre: np.ndarray, words: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The gutter of each page or nan, as :func:`gutter` has it; ``page`` is that of each line, ``widths`` of each page."""
    out = np.full(len(widths), np.nan)
    size = np.bincount(page, minlength=len(widths))
    first_line = np.concatenate(([0], np.cumsum(size)))
    first_item = np.searchsorted(line, first_line)
    for width in np.unique(widths[size >= 8]).tolist():
        xs = _places(width)
        own = np.flatnonzero((size >= 8) & (widths == width))
        if not len(xs):
            continue
        load = np.cumsum(size[own] * len(xs)) // CELLS
        for part in np.split(own, np.flatnonzero(np.diff(load)) + 1):
            items = np.concatenate([np.arange(first_item[p], first_item[p + 1]) for p in part])
            lines = np.concatenate([np.arange(first_line[p], first_line[p + 1]) for p in part])
            of, pages = np.searchsorted(lines, line[items]), np.repeat(np.arange(len(part)), size[part])
            m, one = len(lines), np.ones(len(items))
            begin, end = np.searchsorted(xs - 1, x[items], "right"), np.searchsorted(xs + 1, right[items], "left")
            over = begin < end
            side = np.searchsorted(xs, centre[items], "right")
            # Nothing changes between two places where no item of these pages begins, ends or has its middle.
            events = np.unique(np.concatenate(([0], begin[over], end[over], side)))
            events = events[events < len(xs)]
            k = len(events)
            begin, end, side = (np.searchsorted(events, v) for v in (begin, end, side))
            crosses = _per_line(of[over], begin[over], k, m, one[over]) - _per_line(of[over], end[over], k, m, one[over]) > 0
            at, served = _served(crosses, _per_line(of, side, k, m, one), _per_line(of, side, k, m, words[items]), np.bincount(of, minlength=m), np.bincount(of, words[items], m), pages)
            table = np.zeros((k, len(part)))
            np.maximum.at(table, (at // m, pages[at % m]), served)
            best, first, last = np.zeros(len(part)), np.zeros(len(part)), np.zeros(len(part))
            rows = np.searchsorted(events, np.arange(len(xs)), "right") - 1
            for place, now in zip(xs.tolist(), table[rows]):
                more = now > best
                same = ~more & (now == best) & (best > 0) & (place - last <= 2)
                best[more], first[more], last[more | same] = now[more], place, place
            out[part] = np.where(best > 0, (first + last) / 2, np.nan)
    return out


def _space_at(raw: pa.Array, start: int, stop: int | None) -> np.ndarray:
    """Whether the character there is white space."""
    found = pc.dictionary_encode(pc.utf8_slice_codeunits(raw, start, stop))
    known = np.array([c.isspace() for c in found.dictionary.to_pylist()], bool)
    return known[found.indices.to_numpy()]


def batch_texts(page: np.ndarray, widths: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, text: pa.Array, raw: pa.Array, columns: bool) -> pa.Array:
    """The text of each page (number ``page`` of each item, ascending): :func:`page_text` for all at once. Every page has items."""
    given = (page, x, y, width, height)
    order = np.lexsort((x, y, page))
    line = _line_numbers(page[order], y[order])
    order = order[np.lexsort((x[order], line))]
    page, x, y, width, height = (a[order] for a in given)
    text, raw = text.take(pa.array(order)), raw.take(pa.array(order))
    right = x + width
    if columns:
        centre = x + width / 2
        words = 1 + pc.count_substring_regex(text, _SPACE + "+").to_numpy().astype(float)
        line_page = page[np.flatnonzero(_starts(line))]
        at = _gutters(line, line_page, x, right, centre, words, widths)
        if not np.isnan(at).all():
            place, n = at[page], len(line_page)
            count = lambda mask, weight=None: np.bincount(line[mask], None if weight is None else weight[mask], n)[None, :]
            on_left, every = centre < place, np.ones(len(line), bool)
            crosses = count((x < place - 1) & (right > place + 1)) > 0
            begin, served = _served(crosses, count(on_left), count(on_left, words), count(every), count(every, words), line_page)
            band = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
            parted = (served > 0)[band] & ~np.isnan(at[line_page])
            key = np.where(parted, begin[band], np.arange(n))[line]
            side = np.where(parted[line] & ~on_left, 1, 0)
            again = np.lexsort((line, side, key))
            page, line, x, y, width, height, right, key, side = (a[again] for a in (page, line, x, y, width, height, right, key, side))
            text, raw = text.take(pa.array(again)), raw.take(pa.array(again))
            line = np.cumsum(_starts(key, side, line)) - 1
    first = _starts(line)
    heads = np.flatnonzero(first)
    # What stands before each item: of the first of a line the break, else the gap to the one before.
    separator = np.zeros(len(line), np.int64)
    gap = np.zeros(len(line))
    gap[1:] = x[1:] - right[:-1]
    wide = np.zeros(len(line), bool)
    wide[1:] = gap[1:] > np.maximum(12.0, 1.5 * height[:-1])
    separator[:] = np.where(wide, 2, 1)
    doubtful = np.zeros(len(line), bool)
    if columns and len(line) > 1:
        glyph = width / pc.utf8_length(text).to_numpy()
        size, least = np.maximum(np.maximum(height[1:], height[:-1]), 1.0), np.maximum(np.minimum(glyph[1:], glyph[:-1]), 0.5)
        encoded = _space_at(raw, -1, None)[:-1] | _space_at(raw, 0, 1)[1:]
        spaced = wide[1:] | encoded | (gap[1:] > np.minimum(0.1 * size, 0.2 * least)) | (gap[1:] < -0.5 * least)
        copied = (np.abs(np.diff(x)) <= 2) & pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
        doubtful[1:] = (~spaced | copied) & ~first[1:]
    apart = np.zeros(len(heads), bool)
    apart[1:] = y[heads[1:]] - y[heads[:-1]] > np.maximum(20.0, 1.8 * height[heads[:-1]])
    separator[heads] = np.where(apart, 4, 3)
    separator[_starts(page)] = 0
    if doubtful.any():
        # Lines with items that may be copies or parts of one word depend on the text before: one by one.
        mask = np.isin(line, np.unique(line[doubtful]))
        made: list[str] = []
        at_ = np.flatnonzero(mask)
        told, was = text.take(pa.array(at_)).to_pylist(), raw.take(pa.array(at_)).to_pylist()
        items = [Item(*v) for v in zip(x[at_].tolist(), y[at_].tolist(), width[at_].tolist(), height[at_].tolist(), told, was)]
        bounds = np.flatnonzero(_starts(line[at_])).tolist()
        for a, b in zip(bounds, [*bounds[1:], len(items)]):
            made += [line_text(items[a:b]), *[""] * (b - a - 1)]
        text = pc.replace_with_mask(text, pa.array(mask), pa.array(made, text.type))
        separator[mask & ~first] = 0
    pieces = pc.binary_join_element_wise(_SEPARATORS.take(pa.array(separator)), text, pa.scalar("", pa.large_string()))
    offsets = np.append(np.flatnonzero(_starts(page)), len(page))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), pieces), pa.scalar("", pa.large_string())).cast(pa.string())


def layout_pages(items: DataFrame, columns: bool = True) -> DataFrame:
    """``document_id, page, text`` of ``items``: ``document_id, page, item_no, x, y, width, height, raw, page_width``.

    Items without visible text don't count. ``columns=False`` is the screening's form.
    """
    visible = items.where(F.trim("raw") != "")
    gathered = visible.groupBy("document_id", "page").agg(F.max("page_width").alias("page_width"), F.array_sort(F.collect_list(F.struct("item_no", *_ITEM))).alias("items"))
    return layout_gathered(gathered.select("document_id", "page", "page_width", *(F.col("items")[c].alias(c) for c in _ITEM)), columns)


def layout_gathered(pages: DataFrame, columns: bool = True) -> DataFrame:
    """As :func:`layout_pages`, of pages whose items stand in a row already: ``document_id, page, page_width`` and arrays
    ``x, y, width, height, raw`` of equal length, in the items' order.

    Nothing is shuffled. A page without visible items has no row.
    """
    bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            yield _laid_out(batch, columns)

    kinds = dict(pages.dtypes)
    given = pages.select("document_id", "page", F.col("page_width").cast("double").alias("page_width"), *(F.col(c).cast("array<double>").alias(c) for c in _ITEM[:4]), "raw")
    return given.mapInArrow(run, f"document_id {kinds['document_id']}, page {kinds['page']}, text string")


def _laid_out(batch: pa.RecordBatch, columns: bool) -> pa.RecordBatch:
    page = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(7)), 0).to_numpy())
    raw = batch.column(7).flatten().cast(pa.large_string())
    text = pc.utf8_trim(raw, " ")
    seen = pc.fill_null(pc.not_equal(text, pa.scalar("", pa.large_string())), False)
    raw, text, page = raw.filter(seen), text.filter(seen), page[seen.to_numpy(zero_copy_only=False)]
    x, y, width, height = (batch.column(i).flatten().filter(seen).to_numpy(zero_copy_only=False) for i in range(3, 7))
    there, page = np.unique(page, return_inverse=True)
    widths = batch.column(2).to_numpy(zero_copy_only=False)[there]
    odd = np.zeros(len(there), bool)
    if columns and len(page):
        # Such items share a run of white space with what stands beside them: words aren't a sum over items there.
        odd[page[_space_at(text, 0, 1) | _space_at(text, -1, None)]] = True
    texts: list[str | None] | pa.Array = pa.array([], pa.string())
    plain = ~odd[page]
    if plain.any():
        own = pa.array(np.flatnonzero(plain))
        texts = batch_texts(np.unique(page[plain], return_inverse=True)[1], widths[~odd], x[plain], y[plain], width[plain], height[plain], text.take(own), raw.take(own), columns)
    if odd.any():
        made: list[str | None] = [None] * len(there)
        for p, t in zip(np.flatnonzero(~odd).tolist(), texts.to_pylist()):
            made[p] = t
        for p in np.flatnonzero(odd).tolist():
            a, b = np.searchsorted(page, [p, p + 1]).tolist()
            values = zip(*(v[a:b].tolist() for v in (x, y, width, height)), text.slice(a, b - a).to_pylist(), raw.slice(a, b - a).to_pylist())
            made[p] = page_text([Item(*v) for v in values], float(widths[p]), columns)
        texts = pa.array(made, pa.string())
    kept = pa.array(there)
    return pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), texts], names=["document_id", "page", "text"])
