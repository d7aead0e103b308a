"""A page from its recognised words: the operators in their order, as one DataFrame plan.

For words, cells and figures that are tables.  Where a row is a page,
``operators.onepass`` gives the same blocks without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.operators import boxes as B
from leafgrid.operators import lines as L
from leafgrid.operators import words as W
from leafgrid.tables import Chain, in_slices

PAGE = "doc_id"


def assemble(words: DataFrame, cells: DataFrame, figures: DataFrame, slices: int = 1) -> DataFrame:
    """(page, block, place, text, align, size, level, bold) of the blocks of each page.

    words: page, line_no, word_no, word, conf, box, x_size, ratio; cells and
    figures: boxes, figures with ``photo``.  Words in cells are left to the
    tables; what photos, figures, pens and doubt leave is cut to segments, grouped
    to blocks by pitch and size, cleaned, and told its weight, size, alignment
    and heading level.  Pages are taken in as many slices, one after the other,
    as a row of each word and its shuffles are many times the text.
    """

    def some(mine: Column, materialize: Chain) -> DataFrame:
        return _assembled(words.where(mine), cells.where(mine), figures.where(mine), materialize)

    return in_slices(some, words.sparkSession, PAGE, slices, "assembled")


def _assembled(words: DataFrame, cells: DataFrame, figures: DataFrame, materialize: Chain) -> DataFrame:
    key = [PAGE, "line_no", "word_no"]
    # each step reads what is before it more than once, so the plan is cut where that would multiply
    free = materialize(B.outside(words, cells), "words")
    free = materialize(B.flagged(free, figures, key, in_figure=None, in_photo="photo"), "flagged")
    written = W.handwritten(free).select(*key).distinct().withColumn("written", F.lit(True))
    free = free.join(written, key, "left").withColumns({"written": F.coalesce("written", F.lit(False)), "pen": F.lit(False)})
    clean = materialize(W.trim_leading(W.drop_noise(W.keep(free))), "clean")
    kept = L.mark_bold(clean)
    cut = W.segments(kept)
    lines = cut.groupBy(PAGE, "line_no", "seg_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("x_size").alias("x_size"), W.joined().alias("text"),
        (F.sum(F.when(F.col("bold"), F.char_length("word")).otherwise(0)) * 5 >= F.sum(F.char_length("word")) * 3).alias("bold"),
    )
    # columns are segments of the same number; blocks are islands of their lines
    blocked = materialize(L.islands(lines.withColumn("baseline", F.col("y1")), [PAGE, "seg_no"]), "blocked")
    block = [PAGE, "seg_no", "block_no"]
    told = blocked.groupBy(*block).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("x_size").alias("x_size"), F.count(F.lit(1)).alias("n_lines"),
        L.in_order("line_no", "text", "\n").alias("text"), (F.sum(F.when(F.col("bold"), F.char_length("text")).otherwise(0)) * 5 >= F.sum(F.char_length("text")) * 3).alias("bold"),
    )
    bounds = L.column_bounds(blocked)
    sized = L.font_size(blocked.withColumns({"glyphs": F.char_length("text"), "width": (F.col("x1") - F.col("x0")).cast("double"), "ems": F.char_length("text") * 0.5}), block)
    aligned = L.alignment(blocked.join(bounds, PAGE).withColumn("px", F.col("x_size")), block)
    full = told.join(sized, block).join(aligned, block)
    full = full.withColumn("block", F.row_number().over(Window.partitionBy(PAGE).orderBy("seg_no", "block_no")).cast("long") - 1)
    full = materialize(L.block_order(full), "blocks")
    return L.headings(full).select(PAGE, "block", "place", "text", "align", "size", "level", "bold")
