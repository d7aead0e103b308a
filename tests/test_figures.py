"""Figures, photos, second readings and restoration on drawn pages; fonts and visible text in PDFs."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgrid.functions import text as T
from leafgrid.operators import lines as L
from leafgrid.operators import pages as P
from leafgrid.raster import figures as G
from leafgrid.raster import kernels as K
from leafgrid.raster import resample as R
from leafgrid.raster import restore
from leafgrid.raster import sheet as S
from leafgrid.settings import page_workers
from leafgrid.sources import files, fonts, pdf
from leafgrid.streaming import progress

FACE = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"


def page_of(img):
    gray = K.gray(img)
    return S.Page(img, gray, K.binarize(gray), img.copy(), [], 0)


def drawn():
    """A page with print, a red ring, a blue scrawl, a drawing and a photo."""
    rng = np.random.default_rng(0)
    img = np.full((1000, 800, 3), 250, np.uint8)
    words = []
    for y in range(60, 300, 40):
        for x in range(60, 700, 70):
            img[y : y + 18, x : x + 50 : 6] = img[y : y + 18, x + 1 : x + 50 : 6] = 20
            words.append((x, y, x + 50, y + 18))
    yy, xx = np.mgrid[0:1000, 0:800]
    ring = np.abs(np.hypot(yy - 420, xx - 150) - 60) < 7
    img[ring] = (40, 40, 200)
    for t in range(120):  # a pen mark
        img[310 + t // 2 : 316 + t // 2, 500 + t : 506 + t] = (180, 60, 40)
    drawing = (slice(400, 520), slice(400, 560))
    img[drawing] = np.where((rng.random((30, 40)) < 0.4).repeat(4, 0).repeat(4, 1)[..., None], 10, 250)
    ramp = (120 + 60 * np.sin(yy[600:900, 200:500] / 60) + 25 * np.cos(xx[600:900, 200:500] / 50)).astype(np.uint8)
    img[600:900, 200:500] = ramp[..., None]
    return img, words


def near(a, b, slack=16):
    return all(abs(x - y) <= slack for x, y in zip(a, b, strict=True))


def test_figures_photos_and_marks_are_found():
    img, words = drawn()
    page = page_of(img)
    photos = G.photo_boxes(page)
    assert len(photos) == 1 and near(photos[0], (200, 600, 500, 900), 25)
    found = G.figures(page, words, np.zeros(page.ink.shape, np.uint8))
    assert photos[0] in found and any(near(f, (83, 353, 217, 487)) for f in found) and any(near(f, (400, 400, 560, 520)) for f in found)
    assert any(near(f, (500, 310, 626, 376), 24) for f in found) and len(found) == 4
    # words alone are no figures, and cells hide what is in them
    assert G.figures(page, words, np.zeros(page.ink.shape, np.uint8), [(0, 300, 800, 1000)], []) == []


def test_pixels_and_colours_of_figures_and_blocks():
    img, _ = drawn()
    page = page_of(img)
    ring = G.figure_pixels(page, (80, 350, 220, 490), False)
    assert (ring.reshape(-1, 3) == 255).all(axis=1).mean() > 0.5 and (G.figure_pixels(page, (200, 600, 500, 900), True) == img[600:900, 200:500]).all()
    red = np.full((40, 100, 3), 255, np.uint8)
    red[10:30, 10:90] = (30, 30, 180)
    r, g, b = G.block_color(page_of(red), [(0, 0, 100, 40)])
    assert r > 0.8 and g == b < 0.05
    assert G.block_color(page_of(img), [(60, 60, 110, 78)]) is None and G.block_color(page_of(np.full((9, 9, 3), 255, np.uint8)), [(0, 0, 4, 4)]) is None


def test_cells_are_read_in_one_go_and_mapped_back():
    img = np.full((200, 300, 3), 255, np.uint8)
    img[20:40, 30:70] = img[120:140, 180:220] = 0
    page, rules = page_of(img), np.zeros((200, 300), np.uint8)
    cells = [(10, 10, 100, 60), (110, 10, 200, 60), (150, 100, 290, 190)]
    calls = []

    def read(gray):
        calls.append(gray.shape)
        return [(i, f"w{i}", 90, int(x), int(y), int(x + w), int(y + h), float(y + h), 20.0) for i, (x, y, w, h, _) in enumerate(K.components((gray < 128).astype(np.uint8))[1])]

    got = G.read_cells(page, rules, cells, read)
    assert len(calls) == 1 and [(r[0], *r[4:8]) for r in got] == [(0, 30, 20, 70, 40), (2, 180, 120, 220, 140)]
    assert G.read_cells(page, rules, [(0, 60, 20, 80)], read) == [] and len(calls) == 1


def test_missed_text_is_recovered_and_tentative_figures_may_be_text():
    img = np.full((300, 400, 3), 255, np.uint8)
    for x in range(40, 200, 12):
        img[50:70, x : x + 8] = 0  # a line that nobody read
    for x in range(40, 200, 12):
        img[150:170, x : x + 8] = 0  # a known one
    page, rules = page_of(img), np.zeros((300, 400), np.uint8)
    known = [(38, 148, 202, 172)]
    boxes = G.missed_boxes(page, rules, known, 20)
    assert len(boxes) == 1 and near(boxes[0], (34, 44, 206, 76), 8)
    assert G.missed_boxes(page, rules, known, 20, only=[(0, 100, 400, 300)]) == []

    def read(gray):
        return [(0, "text", 80, 40, 95, 200, 115, 115.0, 20.0), (1, "đỏ", 3, 44, 215, 160, 240, 240.0, 20.0), (1, "?", 99, 0, 0, 1, 1, 1.0, 20.0)]

    found, text = G.recovered(page, rules, known, 20, read, tentative=[(36, 146, 204, 174)], syllable=lambda s: s == "đỏ")
    assert [r[1] for block in found for r in block] == ["text", "đỏ"] and text == {0}
    found, text = G.recovered(page, rules, known, 20, lambda g: [(0, "đỏ", 3, 44, 215, 50, 220, 220.0, 20.0)], tentative=[(36, 146, 204, 174)], syllable=lambda s: True)
    assert found == [] and text == set()


def test_names_under_a_seal_are_read():
    page = page_of(np.full((100, 200, 3), 255, np.uint8))
    rows = [(0, "Nguyễn", 92, 30, 30, 60, 40, 40.0, 10.0), (0, "An", 90, 65, 30, 80, 40, 40.0, 10.0), (1, "x", 99, 30, 60, 40, 70, 70.0, 10.0), (2, "one", 99, 30, 60, 40, 70, 70.0, 10.0)]
    got = G.read_in_figures(page, [(10, 10, 100, 90), (0, 0, 5, 5)], [(0, 0, 5, 5)], [], lambda g: rows)
    assert [[r[1] for r in line] for line in got] == [["Nguyễn", "An"]] and got[0][0][3:7] == (20, 20, 50, 30)
    assert G.read_in_figures(page, [(10, 10, 100, 90)], [], [(15, 15, 60, 60)], lambda g: rows) == []


def test_restoration_and_background():
    rng = np.random.default_rng(1)
    light = np.linspace(120, 240, 300)[None, :, None] * np.ones((200, 1, 3))
    img = np.clip(light + rng.normal(0, 3, light.shape), 0, 255).astype(np.uint8)
    img[90:110, 100:200] = (img[90:110, 100:200] * 0.3).astype(np.uint8)
    flat = restore.flat_field(img)
    paper = flat[20:60]
    assert np.ptp(paper.reshape(-1, 300, 3).mean(axis=(0, 2))) < 0.4 * np.ptp(img[20:60].mean(axis=(0, 2)))
    calm = restore.denoised(img)
    assert calm[20:60, 40:60].std() < 0.8 * img[20:60, 40:60].std()
    edge = np.full((40, 40, 3), 120, np.uint8)
    edge[:, 20:] = 160
    crisp = restore.sharpened(edge)
    assert crisp[20, 19, 0] < 120 and crisp[20, 20, 0] > 160
    shade = np.full((200, 200, 3), 200, np.uint8)
    white = restore.clean_border(shade)
    assert (white[:5] == 255).all() and (white[50:150, 50:150] == 200).all()
    hole = np.zeros((200, 300), np.uint8)
    hole[85:115, 95:205] = 255
    full = restore.filled(img, hole)
    assert (full[hole == 0] == img[hole == 0]).all() and np.abs(full[100, 100:200].astype(float) - light[100, 100:200]).max() < 25
    back = restore.background(img, hole, [(95, 85, 120, 115)], widest=150)
    assert back.shape == (100, 150, 3) and back[50, 80].mean() > 150 and back[50, 53].mean() < 120
    assert (restore.filled(img, np.full((200, 300), 255, np.uint8)) >= 0).all()


@pytest.mark.skipif(not os.path.exists(FACE), reason="no font at hand")
def test_fonts_and_visible_text(spark):
    assert fonts.find_font(["none.ttf", "dejavusans.TTF"], ["/nowhere", "/usr/share/fonts"]) == FACE and fonts.find_font(["none.ttf"], ["/usr/share/fonts"]) is None
    font = fonts.load(FACE)
    assert {ord(c) for c in "aếĐ"} <= set(font.glyphs) and 0.2 < font.width("i") < font.width("m") < 1.1 and font.width("mm") == pytest.approx(2 * font.width("m"))
    words = spark.createDataFrame([(1, "Việt", False), (2, "", False), (3, "a͸", True), (4, None, True)], "id int, word string, bold boolean")
    got = {r["id"]: r["ems"] for r in fonts.text_widths(words, fonts.glyph_widths(spark, font), ["id"]).collect()}
    assert got[1] == pytest.approx(font.width("Việt"), abs=1e-6) and got[2] == 0.0 and got[3] == pytest.approx(font.width("a") + 0.5) and got[4] == 0.0
    rows = [(1, 1, 595.0, 842.0, "Tiếng", 72.0, 700.0, 12.0, 100.0, 0, False, [0.8, 0.0, 0.0], None), (1, 2, 595.0, 842.0, "x", 72.0, 700.0, 12.0, 90.0, None, True, None, "failed"), (2, 1, 1.0, 1.0, "x", 1.0, 1.0, 1.0, 90.0, None, True, None, "failed")]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, width double, height double, text string, x double, y double, size double, squeeze double, level int, bold boolean, color array<double>, error string")
    made = {r["doc_id"]: r for r in pdf.documents(df, fonts=[font], creator="test").collect()}
    assert (made[1]["n_pages"], made[1]["n_skipped"]) == (1, 1) and made[2]["pdf"] is None and made[2]["n_skipped"] == 1
    raw = bytes(made[1]["pdf"])
    streams = [zlib.decompress(s.split(b"stream\n", 1)[1].split(b"\nendstream")[0]) for s in raw.split(b"/FlateDecode")[1:]]
    codes = "".join(f"{font.glyphs[ord(c)]:04X}" for c in "Tiếng ")
    assert font.data in streams and any(codes.encode() in s and b"2 Tr" in s and b"0.800 0.000 0.000 rg" in s for s in streams)
    assert any(f"<{font.glyphs[ord('ế')]:04X}> <1EBF>".encode() in s for s in streams) and b"/FontFile2" in raw


def test_pictures_rules_and_resolution_of_pages():
    small = pdf.at_resolution(np.zeros((400, 800, 3), np.uint8), 144, 220)
    assert small.shape == (220, 440, 3) and pdf.at_resolution(small, 144, 220) is small
    raw = pdf.document([{"width": 200, "height": 100, "words": [], "pictures": [(small.tobytes(), 440, 220, 10, 20, 144, 72)], "rules": [(1, 2, 3, 2, 0.1)]}], "t", "c")
    streams = [zlib.decompress(s.split(b"stream\n", 1)[1].split(b"\nendstream")[0]) for s in raw.split(b"/FlateDecode")[1:]]
    assert any(b"q 144.000 0 0 72.000 10.000 20.000 cm /Im0 Do Q\n0.400 w 1.000 2.000 m 3.000 2.000 l S" in s for s in streams) and b"/Width 440" in raw


def test_edited_blocks_grow_within_the_margins(spark):
    rows = [(1, 100.0, 50.0, 80.0, "left", True), (2, 100.0, 50.0, 80.0, "center", True), (3, 40.0, 50.0, 80.0, "right", True), (4, 500.0, 50.0, 900.0, "left", True), (5, 100.0, 50.0, 80.0, "left", False), (6, 540.0, 50.0, 80.0, "left", True), (7, 9.0, 2.0, 1.0, "left", True)]
    df = spark.createDataFrame(rows, "id int, x double, room double, need double, align string, grows boolean").withColumn("page_width", F.lit(595.0))
    got = {r["id"]: (r["left"], r["wide"]) for r in L.grown(df).collect()}
    assert got == {1: (100, 80), 2: (85, 80), 3: (36, 80), 4: (36, 523), 5: (100, 50), 6: (479, 80), 7: (9, 10)}


def exif(turn, order="big"):
    n = lambda v, k: v.to_bytes(k, order)
    tiff = (b"MM" if order == "big" else b"II") + n(42, 2) + n(8, 4) + n(1, 2) + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(turn, 2) + n(0, 2)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda"


def test_exif_turns():
    assert [files.exif_orientation(exif(t, o)) for t in (1, 6, 8) for o in ("big", "little")] == [1, 1, 6, 6, 8, 8]
    assert files.exif_orientation(b"\x89PNG") == files.exif_orientation(b"") == files.exif_orientation(exif(77)) == 1
    img = np.arange(6).reshape(2, 3)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert {k: K.upright(img, k).tolist() for k in want} == want


def test_images_as_a_viewer_shows_them(spark, tmp_path):
    from test_pages import png

    png(tmp_path / "a.png", drawn()[0])
    r = files.image_pages(spark, str(tmp_path / "a.png"), longest=100).first()
    assert (r["height"], r["width"], r["channels"], len(r["data"])) == (100, 80, 3, 100 * 80 * 3)


def test_places_moves_languages_and_long_numbers(spark):
    names = [f"p{i}.png" for i in range(300)] + ["p" + "9" * 60, "p0007.png"]
    df = spark.createDataFrame([(n,) for n in names], "path string").repartition(7)
    got = [r["path"] for r in P.in_natural_order(df).orderBy("place").collect()]
    assert got == sorted(names, key=lambda n: (int("".join(c for c in n if c.isdigit())), n)) and P.in_natural_order(df).agg(F.max("place")).first()[0] == 301
    order = spark.createDataFrame([(i, c) for i, c in enumerate("abcde")], "place long, page string")
    for at, to, want in ((1, 3, "acdbe"), (3, 1, "adbce"), (2, 2, "abcde")):
        assert "".join(r["page"] for r in P.moved(order, at, to).orderBy("place").collect()) == want
    found = P.languages(spark.createDataFrame([("/x/vie.traineddata",), ("/x/eng.traineddata",), ("/x/readme",)], "path string"))
    assert {r["lang"] for r in found.collect()} == {"vie", "eng"}
    assert [page_workers(n) for n in (1, 4, 32)] == [1, 2, 4]


def test_progress_and_cancelling(spark):
    pages = spark.createDataFrame([(2, "c", "bad"), (0, "a", None), (1, "b", None)], "place int, path string, error string")
    told = []
    assert progress.each_page(pages, lambda k, e: told.append((k, e))) == 1 and told == [("a", None), ("b", None), ("c", "bad")]
    with progress.Cancellable(spark) as run:
        assert spark.range(5).count() == 5 and run.group
        run.cancel()
    assert spark.range(3).count() == 3


def test_orientation_reports(spark):
    df = spark.createDataFrame([("Rotate: 90\nOrientation confidence: 3.5\n",), ("none",), (None,)], "r string")
    assert [tuple(r["o"]) for r in df.select(T.orientation(F.col("r")).alias("o")).collect()] == [(90, 3.5), (0, 0.0), (0, 0.0)]


def test_working_copies():
    big = np.zeros((50, 200), np.uint8)
    assert R.capped(big, 100)[0].shape == (25, 100) and R.capped(big, 400)[0] is big


def test_an_engine_of_its_own_process(spark):
    import sys

    from leafgrid.sources.engine import ProcessEngine, png

    echo = "import os, sys; d = sys.stdin.buffer.read(); print(d[:4] == b'\\x89PNG', len(d) > 50, os.environ['OMP_THREAD_LIMIT'])"
    engine = ProcessEngine([sys.executable, "-c", echo])
    img = np.zeros((4, 6, 3), np.uint8)
    assert engine(img.tobytes(), 4, 6).split() == ["True", "True", "1"] and png(img[..., 0])[25] == 0 and png(img)[25] == 2
    with pytest.raises(RuntimeError, match="no page"):
        ProcessEngine([sys.executable, "-c", "import sys; sys.exit('no page')"]).report(img)
    df = spark.createDataFrame([("a", bytearray(img.tobytes()), 4, 6)], "path string, data binary, height int, width int")
    late = files.recognised(df, ProcessEngine([sys.executable, "-c", "import time; time.sleep(9)"], 0.3)).first()
    assert late["hocr"] is None and "TimeoutExpired" in late["error"]
