"""Queries of single predicates, geometry, markup, edits and placement, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as G
from leafgrid.functions import text as T
from leafgrid.operators import boxes as B
from leafgrid.operators import folds
from leafgrid.operators import lines as L
from leafgrid.operators import pages as P
from leafgrid.operators import words as W
from leafgrid.plans import fixtures as fx
from leafgrid.plans.queries import query
from leafgrid.sources import hocr


def _key() -> list[Column]:
    return [F.col("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no")]


_PLAIN = f"regexp_full_match(word, '(?i)[a-zđ{T.MARKED}{T.MARKED.upper()}\\p{{Nd}}{W.PLAUSIBLE.replace(chr(39), chr(39) * 2)}]*')"
_BARE = "regexp_replace(word, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"
#: Words of the shared view, some with a character of another script.
_SOME = "sw AS (SELECT * REPLACE (CASE WHEN word_no % 6 = 1 THEN word || '漢' ELSE word END AS word), (doc_id + word_no) % 3 = 0 AS odd FROM words)"


def _some(spark, d):
    w = fx.words(spark, d)
    return w.withColumns({"word": F.when(F.col("word_no") % 6 == 1, F.concat("word", F.lit("漢"))).otherwise(F.col("word")), "odd": (F.col("doc_id") + F.col("word_no")) % 3 == 0})


@query(fx.sql(f"""
SELECT doc_id, line_no, word_no, {_PLAIN} AS plausible, (conf >= 60 AND regexp_matches(word, '[\\p{{L}}\\p{{N}}_]')) OR (odd AND regexp_full_match({_BARE}, '\\p{{L}}+') AND length({_BARE}) >= 2) AS readable,
       NOT odd AND conf < 30 AND NOT regexp_full_match({_BARE}, '\\p{{L}}+') AS original, regexp_full_match(word, '\\p{{Lu}}[\\p{{L}}-]*') AS proper FROM sw""", "words", more=_SOME))  # fmt: skip
def word_predicates(spark, d):
    w, c = F.col("word"), F.col("conf")
    told = _some(spark, d)
    return told.select(*_key(), W.plausible(w).alias("plausible"), W.readable(w, c, F.col("odd")).alias("readable"), W.shows_original(w, c, F.col("odd")).alias("original"), W.proper(w).alias("proper"))


@query(fx.sql(f"""
SELECT doc_id, line_no, word_no FROM (SELECT *, count(*) OVER l AS n, sum(conf) OVER l AS sure FROM sw WHERE conf >= 70 AND length({_BARE}) >= 2 AND {_PLAIN} AND regexp_matches(word, '[\\p{{L}}\\p{{N}}_]')
  WINDOW l AS (PARTITION BY doc_id, line_no)) WHERE n >= 2 AND sure >= 80 * n""", "words", more=_SOME))  # fmt: skip
def words_in_figures(spark, d):
    return W.inside_figures(_some(spark, d)).select(*_key())


@query(fx.sql(f"""
SELECT doc_id, line_no, word_no, bare AS word FROM (SELECT *, CASE WHEN trim(word, '_~¯') = '' THEN word ELSE trim(word, '_~¯') END AS bare, (conf >= 85 OR {_PLAIN.replace('(word,', "(CASE WHEN trim(word, '_~¯') = '' THEN word ELSE trim(word, '_~¯') END,")}) AS fine FROM
  (SELECT * REPLACE (CASE WHEN word_no % 5 = 2 THEN '_' || word || '~' WHEN word_no % 11 = 3 THEN '|' ELSE word END AS word) FROM sw)) WHERE bare NOT IN ('|', '¦', '®', '©') AND fine""", "words", more=_SOME))  # fmt: skip
def noise_filter(spark, d):
    n = F.col("word_no")
    w = _some(spark, d).withColumn("word", F.when(n % 5 == 2, F.concat(F.lit("_"), "word", F.lit("~"))).when(n % 11 == 3, "|").otherwise(F.col("word")))
    return W.drop_noise(w).select(*_key(), "word")


@query(fx.sql("""
SELECT doc_id, line_no FROM (SELECT doc_id, line_no, sum(length(regexp_replace(word, '[^\\p{L}\\p{N}]', '', 'g'))) AS alnum, count(*) AS n, max(length(word)) AS longest, bool_or(regexp_full_match(word, '\\p{Nd}')) AS digit, sum(conf) AS sure
  FROM (SELECT * REPLACE (CASE WHEN line_no % 3 = 0 THEN word[1] WHEN line_no % 3 = 1 THEN '.' ELSE word END AS word) FROM words WHERE word_no <= line_no % 2) GROUP BY 1, 2)
WHERE alnum = 0 OR (n = 1 AND longest = 1 AND NOT digit) OR (alnum <= 2 AND sure < 85 * n)""", "words"))  # fmt: skip
def isolated_specks(spark, d):
    n = F.col("line_no")
    w = fx.words(spark, d).where(F.col("word_no") <= n % 2).withColumn("word", F.when(n % 3 == 0, F.left("word", F.lit(1))).when(n % 3 == 1, ".").otherwise(F.col("word")))
    return W.specks(w, ["doc_id", "line_no"]).select("doc_id", n.cast("long").alias("line_no"))


@query(fx.sql("""
SELECT doc_id, line_no, word_no, round(CASE WHEN room > 0 THEN least(100.0::DOUBLE, greatest(70.0::DOUBLE, 100 * room / (length(word) * 13.0::DOUBLE))) ELSE 100.0 END, 6) AS squeeze FROM (
  SELECT *, coalesce(lead(x0) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) - x0 - x_size * 0.15::DOUBLE, (x1 - x0) * 1.1::DOUBLE + x_size * 0.1::DOUBLE) AS room FROM words)""", "words"))  # fmt: skip
def word_squeeze(spark, d):
    told = W.placed(fx.words(spark, d).withColumns({"need": F.char_length("word") * 13.0, "x_size": F.col("x_size").cast("double")}))
    return told.select(*_key(), F.round("squeeze", 6).alias("squeeze"))


@query(fx.sql("""
SELECT doc_id, seg, (h * 10 <= x_size * 26 AND w * 2 >= h * 3) OR (h <= x_size * 6 AND w * 2 >= h * 5) AS text_shaped, seg % 5 > 0 AND (seg % 3 = 0 OR (seg % 3 = 1 AND doc_id % 2 = 0)) AS background
FROM (SELECT *, x1 - x0 AS w, (y1 - y0) * (1 + seg % 7) AS h FROM boxes)""", "boxes"))  # fmt: skip
def box_predicates(spark, d):
    s = F.col("seg")
    tall = (F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0") + (F.col("y1") - F.col("y0")) * (1 + s % 7))
    setting = F.when(s % 3 == 0, "on").when(s % 3 == 1, "auto").otherwise("off")
    return fx.boxes(spark, d).withColumn("x_size", F.col("y1") - F.col("y0")).select("doc_id", "seg", B.text_shaped(tall, F.col("x_size")).alias("text_shaped"), B.uses_background(setting, F.col("doc_id") % 2 == 0, s % 5 > 0).alias("background"))


@query(fx.sql("""
SELECT doc_id, seg, CASE WHEN det <> 0 THEN round((c * b2 - c2 * b) / det::DOUBLE, 6) END AS meet_x, CASE WHEN det <> 0 THEN round((a * c2 - a2 * c) / det::DOUBLE, 6) END AS meet_y,
       round(2479 - y0::DOUBLE, 6) AS turned_x, round(x0::DOUBLE, 6) AS turned_y, x0 AS tl_x, y1 AS bl_y,
       round((greatest(la, lb) + 0.05) / (least(la, lb) + 0.05), 6) AS contrast
FROM (SELECT *, a * b2 - a2 * b AS det, 0.2126 * r + 0.7152 * g + 0.0722 * g AS la, 0.2126 * g + 0.7152 * r + 0.0722 * r AS lb FROM (
  SELECT *, x0 AS a, y0 AS b, x1 AS c, (x1 % 7)::BIGINT AS a2, (y1 % 5)::BIGINT AS b2, seg AS c2,
         CASE WHEN x0 % 256 / 255.0::DOUBLE <= 0.03928 THEN x0 % 256 / 255.0::DOUBLE / 12.92 ELSE pow((x0 % 256 / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS r,
         CASE WHEN y0 % 256 / 255.0::DOUBLE <= 0.03928 THEN y0 % 256 / 255.0::DOUBLE / 12.92 ELSE pow((y0 % 256 / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS g FROM boxes))""", "boxes"))  # fmt: skip
def page_geometry(spark, d):
    """Crossings of lines, a quarter turn twice undone and done again, corners in order, contrast of two colours."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    one, two = F.struct(x0.alias("a"), y0.alias("b"), x1.alias("c")), F.struct((x1 % 7).alias("a"), (y1 % 5).alias("b"), F.col("seg").alias("c"))
    there, back = G.quarter_turn(90, F.lit(5000), F.lit(2480)), G.quarter_turn(270, F.lit(2480), F.lit(5000))
    m = G.compose(there, G.compose(back, there))
    quad = G.corners(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x1, y1), (x0, y1), (x0, y0), (x1, y0))]))
    r, g = x0 % 256, y0 % 256
    told = fx.boxes(spark, d).select("doc_id", "seg", G.crossing(one, two).alias("p"), (m[0] * x0 + m[1] * y0 + m[2]).alias("u"), (m[3] * x0 + m[4] * y0 + m[5]).alias("v"), quad.alias("q"), G.contrast(G.luminance(r, g, g), G.luminance(g, r, r)).alias("k"))
    return told.select("doc_id", "seg", F.round("p.x", 6).alias("meet_x"), F.round("p.y", 6).alias("meet_y"), F.round("u", 6).alias("turned_x"), F.round("v", 6).alias("turned_y"), F.col("q")[0]["x"].alias("tl_x"), F.col("q")[3]["y"].alias("bl_y"), F.round("k", 6).alias("contrast"))


@query("""
SELECT DISTINCT word, nfc_normalize(word || chr(769)) AS composed, CASE WHEN strpos(word, 'e') > 0 THEN word[1:strpos(word, 'e') - 1] || 'EE' || word[strpos(word, 'e') + 1:] ELSE word END AS replaced,
  CASE WHEN lower(word)[-2:] = 'óa' THEN lower(word)[1:-3] || 'oá' WHEN lower(word)[-2:] = 'úy' THEN lower(word)[1:-3] || 'uý' WHEN lower(word)[-2:] = 'òe' THEN lower(word)[1:-3] || 'oè' ELSE lower(word) END AS canonical
FROM (SELECT w || CASE length(w) % 4 WHEN 0 THEN 'óa' WHEN 1 THEN 'ÚY' WHEN 2 THEN 'òe' ELSE '' END AS word FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents))""")  # fmt: skip
def normal_forms(spark, d):
    w = fx.read(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct()
    n = F.char_length("w") % 4
    w = w.select(F.concat("w", F.when(n == 0, "óa").when(n == 1, "ÚY").when(n == 2, "òe").otherwise("")).alias("word")).distinct()
    return w.select("word", T.nfc(F.concat("word", F.chr(F.lit(0)) if False else F.lit("́"))).alias("composed"), T.replace_first(F.col("word"), "e", "EE").alias("replaced"), T.canonical(F.col("word")).alias("canonical"))


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    # controls other than tabs can't stand in markup
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", "")


_CLEAN = "trim(regexp_replace(nfc_normalize(word), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), ' ' || chr(9) || chr(160) || chr(8195))"


@query(fx.sql(f"""
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no) - 1 AS word_no, {_CLEAN} AS word, conf::DOUBLE AS conf, x0, y0, x1, y1,
       round((40 + 50 * line_no + x_size - 7 + 0.01::DOUBLE * 1000 / 2)::DOUBLE, 6) AS baseline, x_size::DOUBLE AS x_size
FROM words WHERE {_CLEAN} <> '' """, "words"))  # fmt: skip
def hocr_words(spark, d):
    """Pages written as hOCR and read again."""
    w = fx.words(spark, d)
    word = F.concat(F.lit("<span class='ocrx_word' title='bbox "), F.concat_ws(" ", "x0", "y0", "x1", "y1"), F.lit("; x_wconf "), "conf", F.lit("'>"), _xml(F.col("word")), F.lit("</span>"))
    lines = w.groupBy("doc_id", "line_no", "x_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", word.alias("m")))), lambda s: s["m"]), " ").alias("m"))
    top = (40 + 50 * F.col("line_no")).cast("string")
    line = F.concat(F.lit("<span class='ocr_line' title='bbox 0 "), top, F.lit(" 1000 "), (40 + 50 * F.col("line_no") + F.col("x_size")).cast("string"), F.lit("; baseline 0.01 -7; x_size "), "x_size", F.lit("'>"), "m", F.lit("</span>"))
    pages = lines.groupBy("doc_id").agg(F.concat(F.lit("<html><div class='ocr_par'>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("m")))), lambda s: s["m"]), "\n"), F.lit("</div></html>")).alias("hocr"))
    return hocr.words(pages, "doc_id").select("doc_id", F.col("line_no").cast("long"), F.col("word_no").cast("long"), "word", "conf", *[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")], F.round("baseline", 6).alias("baseline"), "x_size")


@query(fx.sql("SELECT doc_id, seg, conf, x0 + 5 AS x0, y1 - 5 AS y1 FROM (SELECT *, seg % 101 AS conf FROM boxes)", "boxes"))
def title_properties(spark, d):
    title = F.concat(F.lit(" bbox "), F.concat_ws("  ", "x0", "y0", "x1", "y1"), F.lit(" ;; x_wconf "), (F.col("seg") % 101).cast("string"), F.lit("; "))
    m = fx.boxes(spark, d).select("doc_id", "seg", T.properties(title).alias("m"))
    return m.select("doc_id", "seg", F.col("m")["x_wconf"][0].cast("long").alias("conf"), (F.col("m")["bbox"][0].cast("long") + 5).alias("x0"), (F.col("m")["bbox"][3].cast("long") - 5).alias("y1"))


@query(fx.sql("""
SELECT b.doc_id, b.seg, CASE WHEN seg % 11 = 0 THEN 'edited ' || seg ELSE text END AS text FROM boxes b WHERE seg % 7 <> 0 OR seg % 11 = 0""", "boxes"))  # fmt: skip
def edited_blocks(spark, d):
    s = F.col("seg")
    boxes = fx.boxes(spark, d).select("doc_id", "seg", "text")
    edits = boxes.where("seg % 7 = 0 or seg % 11 = 0 or seg % 13 = 0").select("doc_id", "seg", F.when(s % 11 == 0, F.concat(F.lit("edited "), s.cast("string"))).alias("text"), ((s % 7 == 0) & (s % 11 != 0)).alias("deleted"))
    return P.edited(boxes, edits, ["doc_id", "seg"])


@query(fx.sql("""
SELECT doc_id, seg, round(CASE WHEN grows THEN least(greatest(x - CASE align WHEN 'center' THEN (target - room) / 2 WHEN 'right' THEN target - room ELSE 0 END, 36), 595 - 36 - target) ELSE x END, 6) AS left, round(CASE WHEN grows THEN target ELSE greatest(room, 10) END, 6) AS wide
FROM (SELECT *, least(need, 523) AS target, one AND need > room AS grows FROM (SELECT *, (x0 % 560)::DOUBLE AS x, ((x1 - x0) % 300)::DOUBLE AS room, (length(text) * 5)::DOUBLE AS need, seg % 4 > 0 AS one, CASE seg % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS align FROM boxes))""", "boxes"))  # fmt: skip
def grown_blocks(spark, d):
    s = F.col("seg")
    told = fx.boxes(spark, d).select("doc_id", "seg", (F.col("x0") % 560).cast("double").alias("x"), ((F.col("x1") - F.col("x0")) % 300).cast("double").alias("room"), (F.char_length("text") * 5).cast("double").alias("need"), (s % 4 > 0).alias("grows"), F.when(s % 3 == 0, "left").when(s % 3 == 1, "center").otherwise("right").alias("align"), F.lit(595.0).alias("page_width"))
    return L.grown(told).select("doc_id", "seg", F.round("left", 6).alias("left"), F.round("wide", 6).alias("wide"))


@query("""
WITH e AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS place, page_id % 4 * 90 AS rotation FROM pages)
SELECT page_id, CASE WHEN place = 7 THEN 3 WHEN place BETWEEN 3 AND 7 THEN place + 1 ELSE place END AS place, (rotation + 90) % 360 AS rotation,
       CASE page_id % 3 WHEN 0 THEN 'vie' WHEN 1 THEN 'deu+fra' ELSE '' END AS missing FROM e""")  # fmt: skip
def moved_and_turned(spark, d):
    n = F.col("page_id")
    pages = P.numbered(fx.read(spark, d, "pages").select("page_id"), [n])
    told = P.turned(P.moved(pages.withColumn("rotation", n % 4 * 90), 7, 3))
    wanted = F.when(n % 3 == 0, "vie+eng").when(n % 3 == 1, "deu+fra").otherwise("eng")
    return told.select("page_id", "place", "rotation", F.array_join(P.missing_languages(wanted, F.array(F.lit("eng"), F.lit("spa"))), "+").alias("missing"))


#: A page's tables as rows of cells; tables overlap, some are the page itself.
_TABLES = """
tc AS (SELECT doc_id, seg // 6 AS table_no, seg AS cell_no, x0, y0, x1 + (seg // 6 % 3) * 400 AS x1, y1 + (seg // 6 % 2) * 120 AS y1 FROM boxes WHERE seg < 24),
tb AS (SELECT doc_id, table_no, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS area, list({c: cell_no, x0: x0, y0: y0, x1: x1, y1: y1} ORDER BY cell_no) AS cells FROM tc GROUP BY 1, 2),
ta AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY area, table_no) AS k FROM tb),
st AS (SELECT doc_id, 0::BIGINT AS k, [{c: -1::BIGINT, x0: 0::BIGINT, y0: 0::BIGINT, x1: 0::BIGINT, y1: 0::BIGINT}] AS claimed FROM tb GROUP BY 1
  UNION ALL SELECT s.doc_id, t.k, CASE WHEN t.area <= 0.85 * 4000000 AND len(f.free) >= 2 THEN list_concat(s.claimed, f.free) ELSE s.claimed END
  FROM st s JOIN ta t ON t.doc_id = s.doc_id AND t.k = s.k + 1, LATERAL (SELECT list_filter(t.cells, lambda a: len(list_filter(s.claimed, lambda b:
    2 * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0)))) = 0) AS free) f)"""


@query("WITH RECURSIVE " + fx.sql("""
SELECT doc_id, cell_no FROM (SELECT doc_id, unnest(list_transform(claimed, lambda c: c.c)) AS cell_no FROM
  (SELECT doc_id, claimed FROM st QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)) WHERE cell_no >= 0""", "boxes", more=_TABLES).removeprefix("WITH "))
def table_claims(spark, d):
    t = F.floor(F.col("seg") / 6)
    cells = fx.boxes(spark, d).where("seg < 24").select("doc_id", t.alias("table_no"), F.col("seg").alias("cell_no"), "x0", "y0", (F.col("x1") + t % 3 * 400).alias("x1"), (F.col("y1") + t % 2 * 120).alias("y1"))
    w = Window.partitionBy("doc_id", "table_no")
    area = (F.max("x1").over(w) - F.min("x0").over(w)) * (F.max("y1").over(w) - F.min("y0").over(w))
    return folds.claimed_tables(cells.withColumns({"table_area": area, "page_area": F.lit(4000000)})).select("doc_id", "cell_no")


_FOLD = """
sg AS (SELECT doc_id, line_no, seg_no, x0, x1, line_no // 40 AS par, row_number() OVER (PARTITION BY doc_id, line_no // 40 ORDER BY line_no, seg_no) AS k FROM boxes WHERE line_no < 120),
co AS (SELECT doc_id, par, 0::BIGINT AS k, 0::BIGINT AS line_no, 0::BIGINT AS seg_no, 0::BIGINT AS col, []::STRUCT(x0 BIGINT, x1 BIGINT, line BIGINT)[] AS cols FROM sg GROUP BY 1, 2
  UNION ALL SELECT c.doc_id, c.par, s.k, s.line_no, s.seg_no, coalesce(h.at, len(c.cols) + 1) - 1,
    CASE WHEN h.at IS NULL THEN list_append(c.cols, {x0: s.x0, x1: s.x1, line: s.line_no}) ELSE list_transform(c.cols, lambda x, i: CASE WHEN i = h.at THEN {x0: least(x.x0, s.x0), x1: greatest(x.x1, s.x1), line: s.line_no} ELSE x END) END
  FROM co c JOIN sg s ON s.doc_id = c.doc_id AND s.par = c.par AND s.k = c.k + 1,
  LATERAL (SELECT list_transform(c.cols, lambda x: CASE WHEN x.line <> s.line_no THEN least(x.x1, s.x1) - greatest(x.x0, s.x0) ELSE 0 END) AS shared) m,
  LATERAL (SELECT CASE WHEN list_max(m.shared) > 0 THEN list_position(m.shared, list_max(m.shared)) END AS at) h)"""


@query("WITH RECURSIVE " + fx.sql("SELECT doc_id, line_no, seg_no, col AS \"column\" FROM co WHERE k > 0", "boxes", more=_FOLD).removeprefix("WITH "))
def column_assignment(spark, d):
    segs = fx.boxes(spark, d).where("line_no < 120").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "seg_no", "x0", "x1").withColumn("par", F.floor(F.col("line_no") / 40))
    return folds.column_groups(segs, ["doc_id", "par"]).select("doc_id", "line_no", "seg_no", "column")
