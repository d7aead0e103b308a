"""Queries of the pixel kernels on drawn pages, whose SQL says what was drawn.

A page is drawn in the task that measures it, from its document's number (or its
benchmark item's, for the dearer ones).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrid.plans import fixtures as fx
from leafgrid.plans.queries import query
from leafgrid.raster import figures as G
from leafgrid.raster import kernels as K
from leafgrid.raster import resample as R
from leafgrid.raster import sheet as S

_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _measured(ids: DataFrame, shape: str, facts: Callable[[int], tuple]) -> DataFrame:
    """(id, facts of ``shape``) of each id."""
    names = [c.split() for c in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [facts(i) for i in ids]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64())} | {n: pa.array([r[k] for r in rows], _TYPES[t]) for k, (n, t) in enumerate(names)})

    return ids.mapInArrow(run, f"id long, {shape}")


def _ids(spark, d, table: str, column: str) -> DataFrame:
    return fx.read(spark, d, table).select(F.col(column).cast("long").alias("id"))


def _paper(h: int, w: int) -> np.ndarray:
    return np.full((h, w, 3), 250, np.uint8)


@query("""
SELECT doc_id AS id, n AS components, tall::DOUBLE AS height, (n // 6)::BIGINT AS runs, wide::DOUBLE AS stroke FROM (SELECT doc_id, 24 + 6 * (doc_id % 5) AS n, 7 + doc_id % 6 AS tall, 3 + doc_id % 4 AS wide FROM documents)""")  # fmt: skip
def drawn_letters(spark, d):
    """Rows of six marks: threshold, components, their median height, stroke width, rows of ink."""

    def facts(i: int) -> tuple:
        n, tall, wide = 24 + 6 * (i % 5), 7 + i % 6, 3 + i % 4
        img = _paper(260, 200)
        for k in range(n):
            y, x = 15 + k // 6 * 25, 20 + k % 6 * 28
            img[y : y + tall, x : x + wide] = 30
        ink = K.binarize(K.gray(img))
        rows = (ink > 0).any(axis=1)
        return len(K.components(ink)[1]), K.text_height(ink), int((np.diff(rows.astype(int)) == 1).sum()), K.stroke_width(ink, (0, 0, 200, 260))

    return _measured(_ids(spark, d, "documents", "doc_id"), "components long, height double, runs long, stroke double", facts)


@query("""
SELECT doc_id AS id, (r + 1 + c + 1)::BIGINT AS rules, 1::BIGINT AS tables, (r * c)::BIGINT AS cells, 20::BIGINT AS x0, (20 + 60 * c)::BIGINT AS x1 FROM (SELECT doc_id, 2 + doc_id % 3 AS r, 2 + doc_id % 4 AS c FROM documents)""")  # fmt: skip
def drawn_grids(spark, d):
    """Ruled tables: strokes, grids and their cells."""

    def facts(i: int) -> tuple:
        r, c = 2 + i % 3, 2 + i % 4
        img = np.zeros((260, 400), np.uint8)
        for k in range(r + 1):
            img[30 + 40 * k : 32 + 40 * k, 20 : 22 + 60 * c] = 255
        for k in range(c + 1):
            img[30 : 32 + 40 * r, 20 + 60 * k : 22 + 60 * k] = 255
        level, upright, rules = K.rules(img)
        tables = K.tables(level, upright)
        xs = [x for a in rules for x in (a[0], a[2])]
        return len(rules), len(tables), sum(len(t[1]) for t in tables), int(min(xs)), int(max(xs)) - 2

    return _measured(_ids(spark, d, "documents", "doc_id"), "rules long, tables long, cells long, x0 long, x1 long", facts)


@query("""
SELECT doc_id AS id, doc_id % 3 = 0 AS pen, doc_id % 3 = 1 AS seal, doc_id % 3 = 2 AS rule_ink, doc_id % 2 = 0 OR doc_id % 3 = 1 AS decorative, doc_id % 3 <> 2 AS colored, doc_id % 4 * 90 AS turn FROM documents""")  # fmt: skip
def drawn_inks(spark, d):
    """Pen, seal and print: ink colours, a word's pen, a rule's ink, a block's colour, a tinted page (a seal tints a small one), quarter turns."""

    def facts(i: int) -> tuple:
        img = _paper(60, 90)
        if i % 2 == 0:
            img[40:, :] = (200, 230, 200)
        img[10:20, 10:60] = [(180, 60, 40), (40, 40, 200), (20, 20, 20)][i % 3]
        ink = K.binarize(K.gray(img[:30])[:, :70])
        page = S.Page(img, K.gray(img), np.pad(ink, ((0, 30), (0, 20))), img, [], 0)
        turned = K.quarter_turned(img, i % 4 * 90)
        back = next(k for k in (0, 90, 180, 270) if np.array_equal(K.quarter_turned(img, k), turned))
        text = K.text_mask(img, [(10, 10, 60, 20)])
        return K.pen_word(img, ink, (8, 8, 62, 22)), bool(K.red_ink(img)[10:20, 10:60].all()), K.rule_is_ink(img, (10, 15, 59, 15, 2)), K.decorative(img, text | 0, []), G.block_color(page, [(10, 10, 60, 20)]) is not None, back

    return _measured(_ids(spark, d, "documents", "doc_id"), "pen boolean, seal boolean, rule_ink boolean, decorative boolean, colored boolean, turn long", facts)


@query("SELECT doc_id AS id, doc_id % 7 - 3 AS lean, 60::BIGINT AS left, 190::BIGINT AS right FROM documents")
def drawn_lean(spark, d):
    """Leaning text lines, to the degree; and where a run of empty columns begins on either side."""

    def facts(i: int) -> tuple:
        lean = i % 7 - 3
        ink = np.zeros((240, 260), np.uint8)
        x = np.arange(60, 190)
        for y in range(40, 200, 16):
            at = np.rint(y + np.tan(np.deg2rad(lean)) * (x - 125)).astype(int)
            for k in range(5):
                ink[at + k, x] = 255
        share = (ink > 0).mean(axis=0) * 10
        middle = 125
        return round(K.skew(ink)), middle - S.run_end(share[:middle][::-1]), middle + S.run_end(share[middle:])

    return _measured(_ids(spark, d, "documents", "doc_id"), "lean long, left long, right long", facts)


@query("SELECT item_id AS id, true AS sheet, true AS upright, item_id % 2 = 0 AS frame, 1::BIGINT AS photos, 2::BIGINT AS figures FROM benchmark")
def drawn_photos(spark, d):
    """Photographed sheets: corners within three pixels, cut and level; a frame; a photo and a drawing on a page."""

    def facts(i: int) -> tuple:
        page = _paper(420, 300)
        for y in range(40, 380, 20):
            page[y : y + 8, 40:260:9] = page[y : y + 8, 41:260:9] = page[y : y + 8, 42:260:9] = 20
        a = np.deg2rad(i % 21 - 10)
        there = (np.array([[0, 0], [300, 0], [300, 420], [0, 420]]) - [150, 210]) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + [260, 300]
        m = R.perspective([[0, 0], [300, 0], [300, 420], [0, 420]], there)
        cover = R.warped(np.full((420, 300), 255, np.uint8), m, (520, 600), blank=0) > 127
        photo = np.where(cover[..., None], R.warped(page, m, (520, 600)), np.uint8(70)).astype(np.uint8)
        quad = S.outlined_quad(photo)
        done = S.prepared(photo)
        framed = _paper(460, 600)
        if i % 2 == 0:
            framed[60:400, 60:540] = (60, 160, 60)
            framed[80:380, 80:520] = 250
        mixed = _paper(600, 500)
        yy, xx = np.mgrid[0:200, 0:180]
        mixed[40:240, 40:220] = (120 + 50 * np.sin(yy / 40 + i) + 20 * np.cos(xx / 35))[..., None].astype(np.uint8)
        mixed[330:450, 250:400:8] = mixed[330:450, 251:400:8] = mixed[330:332, 250:400] = mixed[448:450, 250:400] = 20
        gray = K.gray(mixed)
        whole = S.Page(mixed, gray, K.binarize(gray), mixed, [], 0)
        return bool(quad is not None and np.abs(quad - S.ordered(there)).max() <= 3), bool("sheet" in done.notes and abs(K.skew(done.ink)) < 0.6), S.frame_quad(framed) is not None, len(G.photo_boxes(whole)), len(G.figures(whole, [], np.zeros(gray.shape, np.uint8)))

    return _measured(_ids(spark, d, "benchmark", "item_id"), "sheet boolean, upright boolean, frame boolean, photos long, figures long", facts)
