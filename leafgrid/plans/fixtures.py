"""Page tables derived from the driver's documents, in Spark and, for the oracle, in SQL.

A document is a page; its lines and words get made-up but fixed boxes, sizes and
confidences by whole-number arithmetic, so both engines see the same pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.operators import onepass
from leafgrid.operators import words as W


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    each = lines.select("doc_id", "line_no", F.posexplode(F.filter(F.split("line", " ", -1), lambda w: w != "")).alias("word_no", "word"))
    d, ln, n = (F.col(c) for c in ("doc_id", "line_no", "word_no"))
    size = F.char_length("word")
    told = each.withColumns({
        "wpx": (12 * size).cast("long"), "gap": F.when((7 * d + 3 * ln + 5 * n) % 11 == 0, 90).otherwise(10).cast("long"),
        "x_size": F.when(ln % 7 == 0, 42).otherwise(30), "conf": (31 * d + 17 * ln + 13 * n) % 101,
        "ratio": 100 + (11 * d + 5 * ln + 3 * n) % 97, "bold": (d + 3 * ln + n) % 4 < 2,
    })
    run = F.sum(F.col("wpx") + F.col("gap")).over(Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("x1", 100 + run).withColumns({"x0": F.col("x1") - F.col("wpx"), "y0": (40 + 50 * ln).cast("long")})
    return told.withColumn("y1", F.col("y0") + F.col("x_size")).drop("wpx", "gap")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as boxes."""
    return W.segment_boxes(words(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("seg % 3 = 0").selectExpr("doc_id", "seg", "x0 - 4 as x0", "y0 - 4 as y0", "x1 + 4 as x1", "y1 + 4 as y1")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("seg % 7 = 0").selectExpr("doc_id", "seg", "x0 - 30 as x0", "y0 - 30 as y0", "x1 + 30 as x1", "y1 + 30 as y1", "seg % 14 = 0 as photo")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line: box, baseline, size, text; the column group is the line's number over 40."""
    w = words(spark, sf_dir)
    agg = w.groupBy("doc_id", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("x_size").alias("x_size"), W.joined().alias("text"), F.count(F.lit(1)).alias("n_words"))
    return agg.withColumns({"grp": F.floor(F.col("line_no") / 40), "baseline": F.col("y1") + 45 * F.floor(F.col("line_no") / 9)})


def pages(ids: pa.Array, texts: pa.StringArray) -> onepass.Pages:
    """The words, cells and figures of some documents as arrays; the same as ``words``, ``cells`` and ``figures``."""
    raw, ends = b"".join(t.as_buffer() for t in texts), np.cumsum([0, *(len(t.as_buffer()) for t in texts)])
    data = np.frombuffer(raw, np.uint8)
    own = (data != 32) & (data != 10)
    # a word begins where the byte before is none of its own, or of another document
    new, parted = own.copy(), np.zeros(len(data) + 1, bool)
    parted[ends] = True
    new[1:] &= ~own[:-1] | parted[1:-1]
    begin, size = np.flatnonzero(new), np.diff(np.flatnonzero(np.append(new[own], True)))
    page = np.repeat(np.arange(len(ids)), np.diff(np.searchsorted(begin, ends)))
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, begin) - np.searchsorted(breaks, ends[:-1])[page]
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[own])).dictionary_encode()
    code, different = np.asarray(coded.indices), coded.dictionary
    in_line = onepass.Groups(page, line)
    no, d = in_line.place(), np.asarray(ids, np.int64)[page]
    if len(d) and max(d.max(), -d.min()) >= 1 << 58:
        raise OverflowError("31 times a doc_id is no long")
    wpx = 12 * onepass.Letters.sizes(different)[code]
    x1 = 100 + in_line.upto(wpx + np.where((7 * d + 3 * line + 5 * no) % 11 == 0, 90, 10))
    x_size, y0 = np.where(line % 7 == 0, 42, 30), 40 + 50 * line
    w = onepass.Words(page, line, no, code, np.fmod(31 * d + 17 * line + 13 * no, 101), 100 + np.fmod(11 * d + 5 * line + 3 * no, 97), x_size, x1 - wpx, y0, x1, y0 + x_size)
    segs = onepass.Groups(page, line, onepass.segments(in_line, no, x_size, w.x0, x1))
    at = page[segs.start]
    seg = onepass.Groups(at).place()

    def areas(every: int, by: int) -> onepass.Areas:
        box = onepass.Areas(at, segs.min(w.x0) - by, segs.min(y0) - by, segs.max(x1) + by, segs.max(w.y1) + by) if len(page) else onepass.Areas(*[at] * 5)
        return box.of(seg % every == 0)

    return onepass.Pages(w, different, areas(3, 4), areas(7, 30), seg[seg % 7 == 0] % 14 == 0)


#: Cumulative tables of the oracle.
CTE = {
    "words": """
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
l1 AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l0),
l2 AS (SELECT doc_id, line_no, unnest(ws) AS word, unnest(range(len(ws))) AS word_no FROM l1),
l3 AS (SELECT *, 12 * length(word) AS wpx, CASE WHEN (7 * doc_id + 3 * line_no + 5 * word_no) % 11 = 0 THEN 90 ELSE 10 END AS gap,
       CASE WHEN line_no % 7 = 0 THEN 42 ELSE 30 END AS x_size, (31 * doc_id + 17 * line_no + 13 * word_no) % 101 AS conf,
       100 + (11 * doc_id + 5 * line_no + 3 * word_no) % 97 AS ratio, (doc_id + 3 * line_no + word_no) % 4 < 2 AS bold FROM l2),
l4 AS (SELECT *, (100 + sum(wpx + gap) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS UNBOUNDED PRECEDING))::BIGINT AS x1 FROM l3),
words AS (SELECT doc_id, line_no, word_no, word, conf, ratio, bold, x_size, x1 - wpx AS x0, x1, 40 + 50 * line_no AS y0, 40 + 50 * line_no + x_size AS y1 FROM l4)""",
    "segs": """
g0 AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY x0, word_no) AS gap, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM words),
g1 AS (SELECT *, median(gap) OVER (PARTITION BY doc_id, line_no) AS mid FROM g0),
segs AS (SELECT doc_id, line_no, word_no, word, conf, ratio, bold, x_size, x0, x1, y0, y1,
         sum(CASE WHEN gap * 2 > x_size * 5 OR (n >= 6 AND gap * 10 > x_size * 13 AND gap > 4 * greatest(mid, 1)) THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id, line_no ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING)::BIGINT AS seg_no FROM g1)""",
    "boxes": """
b0 AS (SELECT doc_id, line_no, seg_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words,
       string_agg(word, ' ' ORDER BY word_no) AS text, max(x_size) AS x_size FROM segs GROUP BY 1, 2, 3),
boxes AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg_no) - 1 AS seg FROM b0)""",
    "cells": "cells AS (SELECT doc_id, seg, x0 - 4 AS x0, y0 - 4 AS y0, x1 + 4 AS x1, y1 + 4 AS y1 FROM boxes WHERE seg % 3 = 0)",
    "figures": "figures AS (SELECT doc_id, seg, x0 - 30 AS x0, y0 - 30 AS y0, x1 + 30 AS x1, y1 + 30 AS y1, seg % 14 = 0 AS photo FROM boxes WHERE seg % 7 = 0)",
    "lines": """
lines AS (SELECT doc_id, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(x_size) AS x_size,
          string_agg(word, ' ' ORDER BY word_no) AS text, count(*) AS n_words, line_no // 40 AS grp,
          max(y1) + 45 * (line_no // 9) AS baseline FROM words GROUP BY doc_id, line_no)""",
}
_NEEDS = {"words": [], "segs": ["words"], "boxes": ["words", "segs"], "cells": ["words", "segs", "boxes"], "figures": ["words", "segs", "boxes"], "lines": ["words"]}


def sql(body: str, *tables: str, more: str = "") -> str:
    """The body behind the tables that it needs and further common table expressions."""
    need = list(dict.fromkeys(x for t in tables for x in [*_NEEDS[t], t]))
    return "WITH " + ",\n".join([*(CTE[t].strip() for t in need), *([more.strip()] if more else [])]) + "\n" + body
