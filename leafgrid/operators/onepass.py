"""From a page's words to its blocks in one pass: the operators of ``words``, ``lines`` and ``boxes`` over arrays of whole pages.

``plans.assembly.assemble`` says the same with a row for each word, which some
twenty joins and windows shuffle and sort.  Where a row is a page, nothing needs
to be shuffled: a batch of pages becomes flat arrays, words in the order of
page, line and number, and each step a few array operations over all of them.
What hangs on a word's letters is asked once for each different word.  Tests
hold the blocks against the other form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafgrid.functions.text import MARKED
from leafgrid.operators.words import NOISE, PLAUSIBLE, SPECKS, WORD_CHAR

# --- fixed values -----------------------------------------------------------
#: Bytes of text that are taken at once, a page at least; it bounds a task's memory, not what is done.
CHUNK = 1 << 20
#: Beyond any number of a page.
FAR = 1 << 40
#: Java's $ also stands before a line's end that is the last character.
END = r"[\r\x{85}\x{2028}\x{2029}]?\z"
ALIGN = ["left", "right", "center", "justify"]
# ----------------------------------------------------------------------------


class Areas(NamedTuple):
    """Boxes on pages; page is a row's number in its batch."""

    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def of(self, at: np.ndarray) -> Areas:
        return Areas(*[v[at] for v in self])


class Words(NamedTuple):
    """Words in the order of page, line and number; ``code`` is a word's place among the different ones."""

    page: np.ndarray
    line: np.ndarray
    no: np.ndarray
    code: np.ndarray
    conf: np.ndarray
    ratio: np.ndarray
    x_size: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray

    def of(self, at: np.ndarray) -> Words:
        return Words(*[v[at] for v in self])


class Pages(NamedTuple):
    """What a batch of pages holds; ``photos`` tells the photos among the figures."""

    words: Words
    different: pa.StringArray
    cells: Areas
    figures: Areas
    photos: np.ndarray


class Groups:
    """Runs of rows that agree in all keys."""

    def __init__(self, *keys: np.ndarray):
        rows = len(keys[0])
        new = np.zeros(rows, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        self.new, self.start = new, np.flatnonzero(new)
        self.id = np.cumsum(new) - 1
        self.size = np.diff(self.start, append=rows)

    def sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.start, dtype=np.int64)

    def min(self, v: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(v, self.start)

    def max(self, v: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(v, self.start)

    def upto(self, v: np.ndarray) -> np.ndarray:
        """Sums within each run, from its first row on."""
        total = np.cumsum(v, dtype=np.int64)
        return total - (total[self.start] - v[self.start])[self.id]

    def place(self) -> np.ndarray:
        return np.arange(len(self.id)) - self.start[self.id]

    def offsets(self) -> pa.Array:
        return pa.array(np.append(self.start, len(self.id)), pa.int32())


def percentile(v: np.ndarray, group: np.ndarray, groups: int, p: float) -> np.ndarray:
    """Of each group's whole numbers, between the two nearest as Spark does it; NaN for a group without.  Rows are in the order of their groups."""
    size = np.bincount(group, minlength=groups)
    if not len(v):
        return np.full(groups, np.nan)
    low, span = v.min(), v.max() - v.min() + 1
    base = group * span
    ordered = np.sort(base + (v - low)) - base + low
    begin = np.cumsum(size) - size
    at = np.maximum(size - 1, 0) * p
    lower, higher = np.floor(at), np.ceil(at)
    last = len(v) - 1
    a, b = (ordered[np.minimum(begin + x.astype(np.int64), last)].astype(float) for x in (lower, higher))
    found = np.where(a == b, a, np.where(lower == higher, a, (higher - at) * a + (at - lower) * b))
    return np.where(size > 0, found, np.nan)


def sorted_by(*keys: np.ndarray) -> np.ndarray | None:
    """The order by these keys, the first one first; None if the rows are in it."""
    less, same = np.zeros(max(len(keys[0]) - 1, 0), bool), True
    for k in keys:
        less |= same & (k[1:] < k[:-1])
        same = same & (k[1:] == k[:-1])
    return np.lexsort(keys[::-1]) if less.any() else None


def covered(page: np.ndarray, x: np.ndarray, y: np.ndarray, areas: Areas) -> np.ndarray:
    """Whether each point (doubled coordinates) lies in an area of its page, borders included.

    Points of one height are a row; an area takes a run of rows, and of each row
    a run of points, whose ends are found by bisection: no point is tested
    against all areas.
    """
    if not len(page) or not len(areas.page):
        return np.zeros(len(page), bool)
    order = sorted_by(page, y, x)
    if order is not None:
        page, x, y = page[order], x[order], y[order]
    rows = Groups(page, y)

    def keyed(group: np.ndarray, v: np.ndarray, of: np.ndarray) -> np.ndarray:
        low, high = of.min(), of.max()
        return group * (high - low + 3) + np.clip(v - low + 1, 0, high - low + 2)

    heights = keyed(page[rows.start], y[rows.start], y)
    first = np.searchsorted(heights, keyed(areas.page, areas.y0 * 2, y))
    many = np.maximum(np.searchsorted(heights, keyed(areas.page, areas.y1 * 2, y), "right") - first, 0)
    area = np.repeat(np.arange(len(many)), many)
    row = first[area] + np.arange(len(area)) - (np.cumsum(many) - many)[area]
    places = keyed(rows.id, x, x)
    begin = np.searchsorted(places, keyed(row, areas.x0[area] * 2, x))
    end = np.searchsorted(places, keyed(row, areas.x1[area] * 2, x), "right")
    some = begin < end
    found = np.cumsum(np.bincount(begin[some], minlength=len(x) + 1) - np.bincount(end[some], minlength=len(x) + 1))[:-1] > 0
    if order is None:
        return found
    out = np.empty(len(x), bool)
    out[order] = found
    return out


def segments(lines: Groups, no: np.ndarray, x_size: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """``seg_no`` of each word, as ``words.segments`` has it."""
    order = sorted_by(lines.id, x0, no)
    if order is not None:
        x0, x1, x_size = x0[order], x1[order], x_size[order]
    gap = np.zeros(len(x0), np.int64)
    gap[1:] = x0[1:] - x1[:-1]
    later = ~lines.new
    middle = percentile(gap[later], lines.id[later], len(lines.start), 0.5)
    wide = (gap * 2 > x_size * 5) | ((lines.size >= 6)[lines.id] & (gap * 10 > x_size * 13) & (gap > 4 * np.fmax(middle, 1.0)[lines.id]))
    seg = lines.upto(wide & later)
    if order is None:
        return seg
    out = np.empty_like(seg)
    out[order] = seg
    return out


class Letters:
    """What each different word is by its letters, as it came and (``bare_``) once strokes around it are off."""

    def __init__(self, words: pa.StringArray):
        kind = rf"^[a-zA-Zđ{MARKED}{MARKED.upper()}\p{{Nd}}{PLAUSIBLE}]*{END}"

        def told(of: pa.Array, pattern: str) -> np.ndarray:
            return np.asarray(pc.match_substring_regex(of, pattern), bool)

        def among(of: pa.Array, these: list[str]) -> np.ndarray:
            return np.asarray(pc.is_in(of, pa.array(these, of.type)), bool)

        self.size = self.sizes(words)
        self.has, self.plausible, self.alphabetic = told(words, WORD_CHAR), told(words, kind), told(words, rf"^\p{{L}}+{END}")
        letters = np.asarray(pc.count_substring_regex(words, r"\p{L}"))
        self.number = told(words, r"\p{Nd}") & (letters <= 1) & ~told(words, rf"[,;.:)]{END}")
        bare = pc.utf8_trim(words, "_~¯")
        self.bare = pc.if_else(pc.equal(bare, ""), words, bare)
        self.bare_size = self.sizes(self.bare)
        self.bare_noise, self.bare_speck, self.bare_plausible = among(self.bare, NOISE), among(self.bare, SPECKS), told(self.bare, kind)

    @staticmethod
    def sizes(words: pa.Array) -> np.ndarray:
        return np.asarray(pc.utf8_length(words), np.int64)


def _kept(w: Words, seen: Letters, figures: Areas, photos: np.ndarray) -> Words:
    """``boxes.flagged``, ``words.handwritten``, ``words.keep``, ``words.drop_noise``."""
    x, y = w.x0 + w.x1, w.y0 + w.y1
    in_figure, in_photo = covered(w.page, x, y, figures), covered(w.page, x, y, figures.of(photos))
    lines = Groups(w.page, w.line)
    height, conf, size, has = w.y1 - w.y0, w.conf, seen.size[w.code], seen.has[w.code]
    tall = height * 100 >= (percentile(height, lines.id, len(lines.start), 0.5) * 112)[lines.id]
    written = ((seen.number[w.code] & (conf < 90)) | (~seen.plausible[w.code] & (conf < 75))) & tall
    sure_line = (percentile(conf, lines.id, len(lines.start), 0.5) >= 80)[lines.id]
    strict = (conf >= 55) | ((conf >= 35) & has & (size >= 2))
    lenient = ~((conf < 15) | ((conf < 40) & (size < 3))) & (has | (conf >= 60))
    other = sure_line & (conf >= 3) & seen.alphabetic[w.code] & (size >= 2)
    keep = np.where(in_figure & ~strict, sure_line & (conf >= 40) & has, lenient | other) & ~in_photo & ~written
    return w.of(np.flatnonzero(keep & ~seen.bare_noise[w.code] & ((conf >= 85) | seen.bare_plausible[w.code])))


def _trimmed(w: Words, seen: Letters) -> Words:
    """``words.trim_leading``."""
    lines = Groups(w.page, w.line)
    speck = seen.bare_speck[w.code] & (w.conf < 95)
    begin = lines.min(np.where(speck, FAR, w.no))
    return w.of(np.flatnonzero(w.no >= np.where(begin == FAR, lines.max(w.no), begin)[lines.id]))


def _bold(w: Words, lines: Groups, chars: np.ndarray, pages: int) -> np.ndarray:
    """``lines.mark_bold``; NaN, the page's reference where it has none, is above and below nothing."""
    known = (chars >= 3) & (w.ratio > 0)
    ref = percentile(w.ratio[known], w.page[known], pages, 0.3)
    ref = np.where(np.bincount(w.page[known], minlength=pages) >= 5, ref, np.nan)[w.page]
    raw, long = w.ratio > 1.25 * ref + 1e-6, chars >= 2
    n_long, heavy, sure = lines.sum(long), lines.sum(long & raw), long & (w.ratio > 0)
    n, middle = lines.sum(sure), percentile(w.ratio[sure], lines.id[sure], len(lines.start), 0.5)
    spread = lines.max(np.where(sure, w.ratio, -FAR)) - lines.min(np.where(sure, w.ratio, FAR))
    beside = np.zeros(len(raw), bool)
    beside[1:] |= raw[:-1] & ~lines.new[1:]
    beside[:-1] |= raw[1:] & ~lines.new[1:]
    weak = w.ratio < 1.3 * ref - 1e-6
    even, most = (n >= 3) & (spread < 0.25 * middle), heavy * 4 >= n_long * 3
    i = lines.id
    bold = np.select([(n_long == 0)[i], even[i], most[i]], [w.ratio > 1.6 * ref + 1e-6, middle[i] > 1.25 * ref + 1e-6, True], raw & (~weak | beside))
    return bold & ~np.isnan(ref)


def _islands(columns: Groups, line: np.ndarray, baseline: np.ndarray, x_size: np.ndarray) -> np.ndarray:
    """``block_no`` of lines in the order of column, baseline and number, as ``lines.islands`` has it."""
    pitch, before = np.full(len(line), FAR), x_size.copy()
    pitch[1:], before[1:] = baseline[1:] - baseline[:-1], x_size[:-1]
    pitch[columns.new] = FAR
    least, x = columns.min(pitch)[columns.id], np.maximum(x_size, before)
    parts = (pitch * 10 > x * 22) | (pitch * 100 > np.maximum(170 * x, 145 * least)) | (x * 10 > np.minimum(x_size, before) * 13)
    return columns.upto(parts & ~columns.new)


def _font_size(blocks: Groups, chars: np.ndarray, x_size: np.ndarray, width: np.ndarray) -> np.ndarray:
    """``lines.font_size`` with half a size as a character's width."""
    natural = x_size / 1.08
    est = np.minimum(natural * 1.3, np.maximum(natural * 0.75, width.astype(float) / (chars * 0.5)))
    plain = percentile(x_size, blocks.id, len(blocks.start), 0.5)
    at = np.flatnonzero(chars >= 4)
    if not len(at):
        return plain
    at = at[np.lexsort((est[at], blocks.id[at]))]
    sure, upto = Groups(blocks.id[at]), np.cumsum(chars[at])
    every = sure.sum(chars[at])
    before = upto[sure.start] - chars[at][sure.start]
    plain[blocks.id[at][sure.start]] = est[at][np.searchsorted(upto, before + (every + 1) // 2)]
    return plain


def _alignment(blocks: Groups, x0: np.ndarray, x1: np.ndarray, px: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Places in ``ALIGN`` as ``lines.alignment`` has them, of lines in the order of block and number; c0 and c1 are of blocks."""
    last = np.append(blocks.new[1:], True)

    def spread(v: np.ndarray, but: np.ndarray) -> np.ndarray:
        return blocks.max(np.where(but, -FAR, v)) - blocks.min(np.where(but, FAR, v))

    wide = np.maximum(c1 - c0, 1)
    tol = np.maximum(blocks.max(px) * 60, wide)
    left, right = blocks.max(x0) - c0, c1 - blocks.min(x1)
    lefts, rights, centres = spread(x0, blocks.new) * 100 < tol, spread(x1, last) * 100 < tol, spread(x0 + x1, np.False_) * 100 < 3 * tol
    one = np.select([(np.abs(left - right) * 100 < np.maximum(2 * tol, 4 * wide)) & (left * 100 > 8 * wide), (right * 100 < 2 * tol) & (left * 100 > 30 * wide)], [2, 1], 0)
    more = np.select([centres & ~lefts, lefts & rights, rights], [2, 3, 1], 0)
    return np.where(blocks.size == 1, one, more)


def _body_size(pages: Groups, size: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """``lines.body_size`` of each run of blocks."""
    order = np.lexsort((size, pages.id))
    size, upto, every = size[order], np.cumsum(chars[order]), pages.sum(chars)
    before, at = upto[pages.start] - chars[order][pages.start], (every - 1) * 0.5
    lower, higher = np.floor(at), np.ceil(at)
    a, b = (size[np.searchsorted(upto, before + x.astype(np.int64) + 1)] for x in (lower, higher))
    return np.where((lower == higher) | (a == b), a, (higher - at) * a + (at - lower) * b)


def _joined(groups: Groups, texts: pa.Array, glue: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(groups.offsets(), texts), glue)


def blocks(given: Pages, pages: int) -> dict[str, np.ndarray | pa.Array] | None:
    """The blocks of all pages of a batch, in the order of page and block; None if no word is left."""
    w, seen = given.words, Letters(given.different)
    w = w.of(np.flatnonzero(~covered(w.page, w.x0 + w.x1, w.y0 + w.y1, given.cells)))
    w = _kept(w, seen, given.figures, given.photos) if len(w.page) else w
    if not len(w.page):
        return None
    w = _trimmed(w, seen)
    in_line, chars = Groups(w.page, w.line), seen.bare_size[w.code]
    bold, seg = _bold(w, in_line, chars, pages), segments(in_line, w.no, w.x_size, w.x0, w.x1)
    order = sorted_by(in_line.id, seg, w.no)
    if order is not None:
        w, chars, bold, seg = w.of(order), chars[order], bold[order], seg[order]

    # lines: a row for each segment, by column and baseline
    g = Groups(w.page, w.line, seg)
    text = _joined(g, seen.bare.take(pa.array(w.code)), " ")
    page, line, seg, size = w.page[g.start], w.line[g.start], seg[g.start], g.max(w.x_size)
    x0, y0, x1, y1 = g.min(w.x0), g.min(w.y0), g.max(w.x1), g.max(w.y1)
    letters = g.sum(chars)
    bold, chars = g.sum(np.where(bold, chars, 0)) * 5 >= letters * 3, letters + g.size - 1
    bounds = [percentile(v, page, pages, p) for v, p in ((x0, 0.1), (x1, 0.9))]
    order = np.lexsort((line, y1, seg, page))
    page, line, seg, size, x0, y0, x1, y1, bold, chars = (v[order] for v in (page, line, seg, size, x0, y0, x1, y1, bold, chars))
    column = Groups(page, seg)
    block_no = _islands(column, line, y1, size)

    # blocks: their lines by number
    again = sorted_by(column.id, block_no, line)
    if again is not None:
        order = order[again]
        page, line, seg, size, x0, y0, x1, bold, chars, block_no = (v[again] for v in (page, line, seg, size, x0, y0, x1, bold, chars, block_no))
    b = Groups(page, seg, block_no)
    text = _joined(b, text.take(pa.array(order)), "\n")
    at = page[b.start]
    align = _alignment(b, x0, x1, size, bounds[0][at], bounds[1][at])
    fitted = _font_size(b, chars, size, x1 - x0)
    letters = b.sum(chars)
    bold, chars = b.sum(np.where(bold, chars, 0)) * 5 >= letters * 3, letters + b.size - 1
    p = Groups(at)
    block, left = p.place(), b.min(x0)
    order = np.lexsort((block, left, np.rint(b.min(y0) / b.max(size)), at))
    place = np.empty_like(block)
    place[order] = block
    body = _body_size(p, fitted, chars)[p.id]
    short = (b.size <= 3) & (chars <= 160)
    large, strong = short & (fitted * 4 >= body * 5), short & bold & (align == 2) & (chars >= 3)
    level = pa.array(np.where(large, 0, 1), mask=~(large | strong))
    return {"page": at, "block": block, "place": place, "text": text, "align": pa.array(ALIGN).take(pa.array(align)), "size": fitted, "level": level, "bold": bold}


def assemble(rows: DataFrame, read: Callable[[pa.Array, pa.StringArray], Pages], page: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(page, block, place, text, align, size, level, bold) of the blocks of each row's page.

    read: makes the words, cells and figures of some rows from their pages and
    texts.  Each row is a page of its own; one without text has no blocks, and
    one whose page is null none either, as joins by page leave none.
    """
    kind = rows.schema[page].dataType
    out = T.StructType([T.StructField(page, kind), *[T.StructField(n, t) for n, t in (("block", T.LongType()), ("place", T.LongType()), ("text", T.StringType()), ("align", T.StringType()), ("size", T.DoubleType()), ("level", T.LongType()), ("bold", T.BooleanType()))]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            ends, begin = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), 0
            while begin < len(ends):
                before = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, before + chunk, "right")))
                some = ids.slice(begin, end - begin)
                found = blocks(read(some, texts.slice(begin, end - begin)), end - begin)
                if found:
                    at = found.pop("page")
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(at)), *[pa.array(v) if isinstance(v, np.ndarray) else v for v in found.values()]], names=out.names)
                begin = end

    return rows.where(rows[page].isNotNull() & rows[text].isNotNull()).select(page, text).mapInArrow(made, out)
