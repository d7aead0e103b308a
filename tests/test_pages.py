import json
import random
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafgrid.functions import geometry as G
from leafgrid.operators import folds, pages
from leafgrid.operators import lines as L
from leafgrid.operators import words as W
from leafgrid.raster import kernels as K
from leafgrid.settings import Settings
from leafgrid.sources import files, hocr, pdf
from leafgrid.streaming import ingest

HOCR = """<html><body><div class="ocr_page"><p class="ocr_par" title="bbox 0 0 200 90">
<span class="ocr_line" title="bbox 10 10 110 40; baseline 0.1 -5; x_size 28"><span class="ocrx_word" title="bbox 10 10 50 40; x_wconf 91"><strong>Ho&#768;a</strong></span>
<span class="ocrx_word" title="bbox 60 10 110 40"> b </span><span class="ocrx_word" title="bbox 1 1 2 2"> </span></span>
<span class="ocr_header" title="bbox 10 50 110 80"><span class="ocrx_word" title="bbox 10 50 50 80; x_wconf 5">c</span></span>
<span class="ocr_other" title="bbox 0 0 1 1"><span class="ocrx_word" title="bbox 0 0 1 1">no</span></span></p>
<p class="ocr_par" title="bbox 0 0 1 1"><span class="ocr_line" title="bbox 0 0 1 1"></span></p></div></body></html>"""


def png(path, img):
    h, w = img.shape[:2]
    raw = b"".join(b"\0" + img[y, :, ::-1].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def page_image(lean=0.0):
    img = np.full((700, 600, 3), 255, np.uint8)
    for row in range(12):
        for k in range(14):
            y = 60 + row * 22 + int(np.tan(np.deg2rad(lean)) * (k * 36 - 250))
            img[y : y + 10, 40 + k * 36 : 62 + k * 36] = 0
    for y in (400, 480, 560):
        img[y : y + 3, 60:520] = 0
    for x in (60, 290, 517):
        img[400:563, x : x + 3] = 0
    return img


def test_hocr_rows_and_errors(spark):
    rows = list(hocr.parse(HOCR, 100, 0))
    assert [r[:5] for r in rows] == [(0, 0, 0, "Hòa", 91.0), (0, 0, 1, "b", 0.0), (0, 1, 0, "c", 5.0)]
    assert rows[0][5:] == (110, 10, 150, 40, 40 - 5 + 0.1 * 100 / 2, 28.0) and rows[2][9:] == (80.0, 30.0)
    got = hocr.words(spark.createDataFrame([(1, HOCR), (2, "<broken"), (3, None)], "page_id long, hocr string")).collect()
    assert len(got) == 4 and [r["page_id"] for r in got if r["error"]] == [2]


def test_images_are_listed_decoded_and_measured(spark, tmp_path):
    for name in ("p10.png", "p9.png"):
        png(tmp_path / name, page_image())
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "bad.png").write_bytes(b"no image")
    listed = files.image_files(spark, [str(tmp_path), str(tmp_path / "missing")]).orderBy("place").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["bad.png", "p9.png", "p10.png"]
    pixels = files.image_pixels(spark, str(tmp_path / "p*.png"))
    facts = K.page_facts(pixels).collect()
    assert all(f["error"] is None and abs(f["skew"]) < 0.1 and f["n_tables"] == 1 and f["n_cells"] == 4 and f["n_rules"] == 6 for f in facts) and len(facts) == 2
    broken = K.page_facts(pixels.withColumn("height", F.lit(7))).first()
    assert broken["error"] and broken["skew"] is None
    done = files.recognised(pixels, lambda data, h, w: HOCR if h == 700 else 1 / 0).collect()
    assert all(r["hocr"] == HOCR for r in done)
    assert "ZeroDivisionError" in files.recognised(pixels.withColumn("height", F.lit(7)), lambda d, h, w: 1 / 0).first()["error"]


def brute_components(mask, diagonal):
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    c, d = a + dy, b + dx
                    if (diagonal or not (dy and dx)) and 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return sorted(out)


def test_components_match_a_flood_fill():
    rng = np.random.default_rng(0)
    for density in (0.1, 0.4, 0.6):
        mask = (rng.random((23, 31)) < density).astype(np.uint8)
        for diagonal in (True, False):
            labels, stats = K.components(mask, diagonal)
            assert sorted(map(tuple, stats.tolist())) == brute_components(mask, diagonal)
            assert ((labels > 0) == (mask > 0)).all()
    assert len(K.components(np.zeros((3, 3), np.uint8))[1]) == 0


def test_pixel_kernels():
    assert abs(K.skew(K.binarize(K.gray(page_image(3.0)[:380]))) - 3.0) < 0.3
    ink = K.binarize(K.gray(page_image()))
    assert set(np.unique(ink)) == {0, 255} and K.text_height(ink) == 10 and K.stroke_width(ink, (36, 60, 66, 70)) == 22
    assert K.stroke_width(ink, (0, 0, 20, 20)) == 0
    blue, red = np.full((4, 4, 3), (180, 60, 40), np.uint8), np.full((4, 4, 3), (40, 40, 200), np.uint8)
    assert K.blue_ink(blue).all() and not K.blue_ink(red).any() and K.red_ink(red, True).all()
    assert K.pen_word(blue, np.ones((4, 4)), (0, 0, 4, 4)) and not K.pen_word(red, np.ones((4, 4)), (0, 0, 4, 4))
    tinted = np.dstack([np.tile(np.arange(100, 228, dtype=np.uint8), (20, 1)) for _ in range(3)])
    tinted[..., 2] -= 40
    fair = K.white_balance(tinted)[:, -10:].reshape(-1, 3).mean(axis=0)
    assert np.ptp(fair) < 3 and K.tone(np.array([[[0, 128, 255]]], np.uint8)).tolist()[0][0][::2] == [0, 255]


def test_geometry(spark):
    r = spark.range(1).select(
        G.compose(G.quarter_turn(90, F.lit(10), F.lit(20)), G.quarter_turn(270, F.lit(20), F.lit(10))).alias("m"),
        G.corners(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9, 1), (0, 0), (1, 8), (10, 9))])).alias("c"),
        G.crossing(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(3.0).alias("c")), F.struct(F.lit(0.0).alias("a"), F.lit(2.0).alias("b"), F.lit(8.0).alias("c"))).alias("p"),
        G.contrast(G.luminance(F.lit(0), F.lit(0), F.lit(0)), G.luminance(F.lit(255), F.lit(255), F.lit(255))).alias("k"),
        G.page_map(F.lit(2000), F.lit(1000), 595.0, 842.0).alias("g"),
    ).first()
    assert r["m"] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and [tuple(c) for c in r["c"]] == [(0, 0), (9, 1), (10, 9), (1, 8)]
    assert tuple(r["p"]) == (3.0, 4.0) and abs(r["k"] - 21) < 1e-9 and r["g"]["pw"] == 842.0 and r["g"]["oy"] > 0


def test_table_claims():
    page = {"doc_id": 1, "page_area": 10000}
    cells = [(0, 0, 0, 0, 50, 50), (0, 1, 50, 0, 100, 50), (1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10), (2, 0, 0, 0, 9, 9), (2, 1, 60, 60, 70, 70), (3, 0, 0, 0, 99, 99), (3, 1, 1, 1, 2, 2)]
    area = {0: 5000, 1: 200, 2: 4900, 3: 9801}
    pdf_ = pd.DataFrame([{**page, "table_no": t, "cell_no": c, "x0": a, "y0": b, "x1": x, "y1": y, "table_area": area[t]} for t, c, a, b, x, y in cells])
    got = folds.claim_cells(pdf_)
    # 1 claims first; 2 loses a cell to it and claims nothing; 0 keeps both; 3 is the page
    assert sorted(zip(got["table_no"], got["cell_no"], strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_column_assignment_widens_columns(spark):
    rows = [(1, 0, 0, 0, 100), (1, 0, 1, 300, 400), (1, 1, 0, 50, 320), (1, 2, 0, 310, 390), (1, 2, 1, 500, 600)]
    got = folds.column_groups(spark.createDataFrame(rows, "doc_id long, line_no long, seg_no long, x0 long, x1 long"), ["doc_id"]).collect()
    assert [r["column"] for r in sorted(got, key=lambda r: (r["line_no"], r["seg_no"]))] == [0, 1, 0, 1, 2]


def test_merge_and_insert_folds(spark):
    shape = "doc_id long, line_no long, word_no long, word string, conf long, x0 long, y0 long, x1 long, y1 long, baseline double, x_size double, fresh boolean"
    old = [(1, 0, 0, "a", 90, 0, 0, 20, 20, 20.0, 20.0, False), (1, 0, 1, "c", 90, 100, 0, 120, 20, 20.0, 20.0, False), (1, 1, 0, "b", 80, 0, 60, 20, 80, 80.0, 20.0, False)]
    run = [(1, 0, 0, "b", 90, 40, 0, 60, 20, 22.0, 20.0, True), (1, 0, 1, "c", 70, 102, 0, 130, 20, 22.0, 20.0, True), (1, 0, 2, "z", 90, 5, 0, 19, 20, 22.0, 20.0, True)]
    more = [(1, 1, 0, "far", 90, 0, 500, 20, 520, 520.0, 20.0, True), (1, 2, 0, "ăng", 60, 22, 60, 70, 80, 80.0, 20.0, True), (1, 3, 0, "wide", 60, 321, 0, 340, 20, 24.0, 20.0, True), (1, 4, 0, "near", 60, 210, 0, 240, 20, 23.0, 20.0, True)]
    df = spark.createDataFrame(old + run + more, shape)
    got = {r["word"]: (r["line_no"], r["x0"], r["x1"], r["conf"]) for r in folds.merged_words(df, syllables=["băng"]).collect()}
    # "near" is the most of four sizes from the line, "wide" a pixel more from "near"
    assert got == {"a": (0, 0, 20, 90), "c": (0, 100, 130, 90), "b": (0, 40, 60, 90), "far": (-1, 0, 20, 90), "băng": (1, 0, 70, 60), "near": (0, 210, 240, 60), "wide": (-1, 321, 340, 60)}
    twice = pd.DataFrame([("x", 50, 0, 0, 10, 9, 0), ("x", 70, 14, 1, 20, 8, 1), ("x", 90, 60, 1, 70, 8, 2)], columns=["word", "conf", "x0", "y0", "x1", "y1", "word_no"])
    assert folds.rejoin(twice, 20, frozenset())[["conf", "x0", "y0", "x1", "y1"]].to_numpy().tolist() == [[70, 0, 0, 20, 9], [90, 60, 1, 70, 8]]
    blocks = [(1, 0, 0, None), (1, 1, 100, None), (1, None, 50, 0.0), (1, None, 40, 1.0), (1, None, 500, 2.0)]
    out = folds.inserted(spark.createDataFrame(blocks, "doc_id long, block long, y0 long, fresh double")).collect()
    assert [r["y0"] for r in sorted(out, key=lambda r: r["block"])] == [0, 40, 50, 100, 500]


def test_noise_specks_and_placement(spark):
    rows = [(1, 0, 0, "|", 99, 0, 10, 30), (1, 0, 1, "_word~", 50, 20, 60, 30), (1, 0, 2, "漢", 50, 70, 80, 30), (1, 0, 3, "~~", 90, 90, 99, 30), (2, 0, 0, "x", 99, 0, 10, 30), (3, 0, 0, "7", 99, 0, 10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, word_no long, word string, conf long, x0 long, x1 long, x_size long")
    assert [r["word"] for r in W.drop_noise(df).where("doc_id = 1").orderBy("word_no").collect()] == ["word", "~~"]
    assert [r["doc_id"] for r in W.specks(df.where("doc_id > 1"), ["doc_id"]).collect()] == [2]
    squeeze = [r["squeeze"] for r in W.placed(df.where("doc_id = 1").withColumn("need", F.lit(20.0))).orderBy("word_no").collect()]
    assert squeeze[0] == 77.5 and squeeze[1] == 100.0 and squeeze[3] == 70.0


def test_lower_weighted_median(spark):
    rows = [(1, 100, 10, 10.0, 5), (1, 100, 20, 10.0, 5), (2, 27, 3, 1.0, 30)]
    df = spark.createDataFrame(rows, "doc_id long, width long, x long, ems double, glyphs long").withColumn("x_size", F.lit(10.8))
    got = {r["doc_id"]: r["size"] for r in L.font_size(df.withColumn("width", F.col("x") * F.col("ems")), ["doc_id"]).collect()}
    assert got[1] == 10.0  # not the middle between 10 and 13
    assert got[2] == 7.5


def test_status_edits_and_errors(spark):
    entries = spark.createDataFrame([("a", "k", 0), ("b", "k", 360), ("c", "k", 0)], "path string, ocr_key string, rotation int")
    status = spark.createDataFrame([("a", "k", 0, False), ("b", "k", 0, True)], "path string, ocr_key string, rotation int, failed boolean")
    assert sorted(r["path"] for r in pages.stale(entries, status).collect()) == ["b", "c"]
    assert pages.turned(entries).where("path = 'b'").first()["rotation"] == 90
    blocks = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, text string")
    edits = spark.createDataFrame([(1, "new", False), (2, None, True), (3, None, False)], "id long, text string, deleted boolean")
    assert {tuple(r) for r in pages.edited(blocks, edits, ["id"]).collect()} == {(1, "new"), (3, "z")}
    missing = spark.range(1).select(pages.missing_languages(F.lit("vie+eng"), F.array(F.lit("vie"))).alias("m")).first()["m"]
    assert missing == ["eng"]


def test_settings_round_trip():
    s = Settings(lang="vie+eng", auto_crop=False)
    assert Settings.from_json(s.to_json()) == s and s.ocr_key() != Settings().ocr_key()
    assert Settings(font="x").ocr_key() == Settings().ocr_key()
    assert Settings.from_json('{"auto_crop": "false", "unknown": 1}').auto_crop is False


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\nBác  Sĩ\n\nhoà bình\n", encoding="utf-8")
    (tmp_path / "d.txt").write_text("bác sĩ\n", encoding="utf-8")
    got = {tuple(r) for r in files.lexicon_tables(spark, str(tmp_path / "p.txt"), [str(tmp_path / "d.txt")]).collect()}
    assert got == {("bác sĩ", True), ("hoà bình", False)}
    (tmp_path / "x.txt").write_text("Bà Rịa - Vũng Tàu\n", encoding="utf-8")
    assert {r[0] for r in files.place_phrases(spark, str(tmp_path / "x.txt")).collect()} == {"bà rịa - vũng tàu", "bà rịa-vũng tàu"}
    tree = {"data": [{"name": "Tỉnh An Bình", "level2s": [{"name": "Quận 3", "level3s": [{"name": "Phường Bến Nghé"}]}, {"name": "Xã X"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree), encoding="utf-8")
    names = [r[0] for r in files.place_names(spark, str(tmp_path / "t.json"), ["tỉnh", "quận", "phường"]).collect()]
    assert names == sorted(["tỉnh an bình", "an bình", "quận 3", "phường bến nghé", "bến nghé", "xã x"])
    files.write_names(spark.createDataFrame([("b",), ("a",)], "name string"), str(tmp_path / "out"), "head")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# head", "a", "b"]
    (tmp_path / "g.json").write_text('{"text": ["a b"], "bold": []}')
    assert files.truth(spark, str(tmp_path / "g.json")).first()["text"] == ["a b"]


def test_text_and_pdf_sinks(spark, tmp_path):
    files.write_text(spark.createDataFrame([(2, "two"), (1, "one\n\nblock")], "page_no int, text string"), str(tmp_path / "t"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("part-*"))).decode()
    assert text == "one\n\nblock\n\n\ftwo\n"
    rows = [(1, 1, 595.0, 842.0, "Tiếng", 72.0, 700.0, 12.0, 100.0, 0), (1, 2, 595.0, 842.0, "Việt", 72.0, 700.0, 12.0, 90.0, 1), (2, 1, 595.0, 842.0, "x", 1.0, 1.0, 9.0, 100.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, width double, height double, text string, x double, y double, size double, squeeze double, level int")
    made = {r["doc_id"]: r for r in pdf.documents(df).collect()}
    assert made[1]["n_pages"] == 2 and made[2]["n_pages"] == 1
    raw = bytes(made[1]["pdf"])
    at = int(raw[raw.rindex(b"startxref") + 9 :].split()[0])
    assert raw[at : at + 4] == b"xref" and raw.count(b"/Title") == 3 and made[1]["n_skipped"] == 0
    for line in raw[at:].split(b"\n")[3:-6]:
        if line.endswith(b" n "):
            assert raw[int(line[:10]) :].split(b" obj")[0].split()[0].isdigit()
    streams = [zlib.decompress(s.split(b"stream\n", 1)[1].split(b"\nendstream")[0]) for s in raw.split(b"/FlateDecode")[1:]]
    assert any("Tiếng ".encode("utf-16-be").hex().encode() in s for s in streams)


def test_stream_takes_stale_pages_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    png(folder / "a.png", page_image()[:20, :20])
    (folder / "b.txt").write_text("x")

    def run():
        work = lambda df: df.select("path", F.lit(None).cast("string").alias("error"))
        ingest.recognise_stream(ingest.image_stream(spark, str(folder)), Settings(), str(tmp_path / "status"), work, str(tmp_path / "ck")).awaitTermination()
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "status")).collect())

    assert run() == ["a.png"]
    png(folder / "c.png", page_image()[:20, :20])
    assert run() == ["a.png", "c.png"] and run() == ["a.png", "c.png"]


def test_random_islands_against_a_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(30):
        y, block, before = 0, 0, None
        lines = []
        for n in range(12):
            y += rng.choice([20, 30, 40, 55, 70])
            lines.append((g, n, y, rng.choice([20, 22, 30])))
        least = min(b[2] - a[2] for a, b in zip(lines, lines[1:], strict=False))
        for line in lines:
            if before:
                pitch, x = line[2] - before[2], max(line[3], before[3])
                block += pitch > 2.2 * x + 1e-9 or pitch > max(1.7 * x, 1.45 * least) + 1e-9 or x > 1.3 * min(line[3], before[3]) + 1e-9
            want[g, line[1]] = block
            before = line
        rows += lines
    got = L.islands(spark.createDataFrame(rows, "grp long, line_no long, baseline long, x_size long"), ["grp"]).collect()
    assert {(r["grp"], r["line_no"]): r["block_no"] for r in got} == want


def test_word_and_box_predicates(spark):
    from leafgrid.operators import boxes as B

    rows = [(1, 0, 0, "(chữ)", 20, True), (1, 0, 1, "ab", 90, False), (1, 0, 2, "漢字", 99, False), (1, 0, 3, "cd", 75, False), (1, 1, 0, "ef", 99, False), (1, 2, 0, "..", 10, True)]
    df = spark.createDataFrame(rows, "doc_id long, line_no long, word_no long, word string, conf long, tentative boolean")
    assert [r["word"] for r in df.where(W.readable(F.col("word"), F.col("conf"), F.col("tentative"))).orderBy("line_no", "word_no").collect()] == ["(chữ)", "ab", "漢字", "cd", "ef"]
    assert sorted(r["word"] for r in W.inside_figures(df).collect()) == ["ab", "cd"]
    assert [r["word"] for r in df.where(W.shows_original(F.col("word"), F.col("conf"), F.lit(False))).collect()] == [".."]
    assert spark.range(1).select(W.proper(F.lit("Bà-Rịa")).alias("a"), W.proper(F.lit("bà")).alias("b")).first()[:] == (True, False)
    box = lambda w, h: (F.lit(0), F.lit(0), F.lit(w), F.lit(h))
    r = spark.range(1).select(*[B.text_shaped(box(w, h), F.lit(10)).alias(f"c{w}_{h}") for w, h in ((60, 26), (30, 26), (150, 60), (150, 70))], B.uses_background(F.lit("auto"), F.lit(True), F.lit(True)).alias("u")).first()
    assert r[:] == (True, False, True, False, True)


def test_reflow_wraps_by_room(spark):
    df = spark.createDataFrame([(1, "aa bb cccccccccccc dd", 38.0, 10.0, 0.5)], "block long, text string, room double, size double, em double")
    got = [r["text"] for r in L.reflow(df, ["block"]).orderBy("row_no").collect()]
    assert got == ["aa bb", "cccccccccccc", "dd"]


def test_light_margins_and_masks():
    page = page_image()
    shade = np.linspace(0.5, 1, 600)[None, :, None]
    dim = (page * shade).astype(np.uint8)
    even = K.even_light(dim)
    assert even[20, 100].min() > 235 and even[65, 45].max() < 60
    dark = page.copy()
    dark[:15] = 20
    (trimmed,) = K.trim_margins(dark)
    assert (trimmed[:15] == 255).all() and (trimmed[15:] == page[15:]).all()
    found = K.rules(K.binarize(K.gray(page)))[2]
    assert K.rule_is_ink(page, found[0]) and not K.rule_is_ink(np.full_like(page, 200), found[0])
    mask = K.text_mask(page, [(36, 55, 70, 75)])
    assert mask[65, 45] == 255 and mask[300, 45] == 0
    assert not K.decorative(page, mask, []) and K.decorative(np.full((50, 50, 3), (200, 150, 240), np.uint8), np.zeros((50, 50), np.uint8), [])
    assert K.quarter_turned(page, 90).shape[:2] == (600, 700) and (K.quarter_turned(K.quarter_turned(page, 90), 270) == page).all()


def test_new_paths_come_as_often_as_in_their_sql(spark):
    def told(new, listed):
        frames = [spark.createDataFrame([(p,) for p in ps], "path string") for ps in (new, listed)]
        return sorted(r["path"] or "null" for r in pages.unlisted(*frames).collect())

    assert told(["a", "b", "a", "c", None], ["c"]) == ["a", "a", "b"]
    assert told(["a", None], ["c", None]) == []
    assert told(["a", "a", None], []) == ["a", "a", "null"]


def test_assembly_in_slices_is_whole_and_leaves_only_its_result(spark):
    import os

    from leafgrid.plans import assembly
    from leafgrid.plans import fixtures as fx
    from leafgrid.tables import shared_dir

    here = "/root/testdata/sf0.001"
    parts = [t.where("doc_id % 20 = 0") for t in (fx.words(spark, here).drop("bold"), fx.cells(spark, here), fx.figures(spark, here))]
    one, two = (sorted(map(tuple, assembly.assemble(*parts, slices=n).collect())) for n in (1, 2))
    assert one and one == two
    left = os.listdir(shared_dir(spark).removeprefix("file:") + "/leafgrid")
    assert not any(x.startswith(("words-", "flagged-", "clean-", "blocked-", "blocks-")) for x in left)
