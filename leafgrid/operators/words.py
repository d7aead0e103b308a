"""Operators on words: rows (page, line, word ordinal, text, box, confidence).

Page and line columns default to ``doc_id`` and ``line_no``.  Everything is
partitioned by page and line, so the windows of one operator share a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import text as T

LINE = ["doc_id", "line_no"]
WORD_CHAR = r"[\p{L}\p{N}_]"
#: Punctuation that counts as plausible besides Latin letters with Vietnamese marks and digits.
PLAUSIBLE = r""".,;:!?\-–—/\\()\[\]"'“”‘’%&+*=@#°<>_…"""
NOISE = ["|", "¦", "®", "©"]
SPECKS = [".", ",", ":", ";", "'", "`", "¡"]


def plausible(word: Column) -> Column:
    """Only Latin letters with Vietnamese diacritics, digits and ordinary punctuation (composed text)."""
    return word.rlike(rf"(?i)^[a-zđ{T.MARKED}{T.MARKED.upper()}\p{{Nd}}{PLAUSIBLE}]*$")


def good(word: Column, conf: Column, strict: bool) -> Column:
    """Whether a recognised word can be trusted."""
    has = word.rlike(WORD_CHAR)
    if strict:
        return (conf >= 55) | ((conf >= 35) & has & (F.char_length(word) >= 2))
    return ~((conf < 15) | ((conf < 40) & (F.char_length(word) < 3))) & (has | (conf >= 60))


def handwritten(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Words that look handwritten: numbers without a closing mark, or implausible and unsure, taller than their line's median by 12 %."""
    height = F.col("y1") - F.col("y0")
    middle = F.median(height).over(Window.partitionBy(*line))
    letters = F.char_length(F.regexp_replace("word", r"[^\p{L}]", ""))
    number = F.col("word").rlike(r"\p{Nd}") & (letters <= 1) & ~F.col("word").rlike(r"[,;.:)]$") & (F.col("conf") < 90)
    odd = ~plausible(F.col("word")) & (F.col("conf") < 75)
    return words.withColumn("middle", middle).where((number | odd) & (height * 100 >= F.col("middle") * 112)).drop("middle")


def keep(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Of words with flags ``in_photo``, ``in_figure``, ``written`` and ``pen``: those that belong to the text.

    The order of the rules matters; a line's median confidence is over all its words.
    """
    middle = F.median("conf").over(Window.partitionBy(*line))
    w, c = F.col("word"), F.col("conf")
    verdict = (
        F.when(F.col("in_photo"), False)
        .when(F.col("written") | ((c < 90) & F.col("pen")), False)
        .when(F.col("in_figure") & ~good(w, c, True), (F.col("middle") >= 80) & (c >= 40) & w.rlike(WORD_CHAR))
        .when(good(w, c, False), True)
        .otherwise((F.col("middle") >= 80) & (c >= 3) & T.alphabetic(w) & (F.char_length(w) >= 2))
    )
    return words.withColumn("middle", middle).where(verdict).drop("middle")


def segments(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Adds ``seg_no``: a line falls apart at gaps over 2.5 sizes and, with six words or more, at gaps over 1.3 sizes and four median gaps."""
    w = Window.partitionBy(*line).orderBy("x0", "word_no")
    whole = Window.partitionBy(*line)
    gapped = words.withColumns({"gap": F.col("x0") - F.lag("x1").over(w), "n": F.count(F.lit(1)).over(whole)})
    gapped = gapped.withColumn("mid", F.median("gap").over(whole))
    wide = (F.col("gap") * 2 > F.col("x_size") * 5) | ((F.col("n") >= 6) & (F.col("gap") * 10 > F.col("x_size") * 13) & (F.col("gap") > 4 * F.greatest(F.col("mid"), F.lit(1.0))))
    return gapped.withColumn("seg_no", F.sum(F.when(wide, 1).otherwise(0)).over(w)).drop("gap", "n", "mid")


def segment_boxes(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """A row per segment: its box, text, word count, and its place ``seg`` on the page."""
    told = segments(words, line)
    boxes = told.groupBy(*line, "seg_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n_words"), joined().alias("text"), F.max("x_size").alias("x_size"))
    place = F.row_number().over(Window.partitionBy(line[0]).orderBy("line_no", "seg_no")) - 1
    return boxes.withColumn("seg", place.cast("long"))


def joined(order: str = "word_no", word: str = "word", glue: str = " ") -> Column:
    """Aggregate: the words in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda s: s[word]), glue)


def dedupe_adjacent(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Equal neighbours closer than half a size become one word: the union of their boxes, the larger confidence."""
    w = Window.partitionBy(*line).orderBy("word_no")
    same = (F.lag("word").over(w) == F.col("word")) & ((F.col("x0") - F.lag("x1").over(w)) * 2 < F.col("x_size"))
    runs = words.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w))
    return runs.groupBy(*line, "run").agg(F.min("word_no").alias("word_no"), F.first("word").alias("word"), F.max("conf").alias("conf"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("run")


def trim_leading(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Drops unsure specks that open a line, but never its last word."""
    w = Window.partitionBy(*line)
    speck = F.col("word").isin(SPECKS) & (F.col("conf") < 95)
    begin = F.coalesce(F.min(F.when(~speck, F.col("word_no"))).over(w), F.max("word_no").over(w))
    return words.withColumn("begin", begin).where("word_no >= begin").drop("begin")


def drop_noise(words: DataFrame) -> DataFrame:
    """Strips strokes read as ``_ ~ ¯`` (unless nothing is left), drops noise marks and implausible words below confidence 85."""
    bare = F.btrim("word", F.lit("_~¯"))
    cleaned = words.withColumn("word", F.when(bare == "", F.col("word")).otherwise(bare))
    return cleaned.where(~F.col("word").isin(NOISE) & ((F.col("conf") >= 85) | plausible(F.col("word"))))


def specks(words: DataFrame, block: list[str]) -> DataFrame:
    """Keys of blocks that are isolated specks: no letter or digit, a lone letter, or at most two with a mean confidence below 85."""
    agg = words.groupBy(*block).agg(F.sum(F.char_length(F.regexp_replace("word", r"[^\p{L}\p{N}]", ""))).alias("alnum"), F.count(F.lit(1)).alias("n"), F.max(F.char_length("word")).alias("longest"), F.max(F.col("word").rlike(r"^\p{Nd}$")).alias("digit"), F.sum("conf").alias("sure"))
    lone = (F.col("n") == 1) & (F.col("longest") == 1) & ~F.col("digit")
    return agg.where((F.col("alnum") == 0) | lone | ((F.col("alnum") <= 2) & (F.col("sure") < 85 * F.col("n")))).select(*block)


def split_boxes(words: DataFrame, parts: str = "parts") -> DataFrame:
    """A word with an array of parts becomes a row per part; its width goes by length, gaps of 0.6 characters, borders cut to whole numbers."""
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + F.char_length(p)) + 0.6 * (F.size(parts) - 1)
    wide = words.withColumn("unit", (F.col("x1") - F.col("x0")) / total)
    each = wide.select("*", F.posexplode(parts).alias("part_no", "part"))
    before = F.aggregate(F.slice(parts, F.lit(1), F.col("part_no")), F.lit(0.0), lambda a, p: a + F.char_length(p)) + 0.6 * F.col("part_no")
    begin = F.col("x0") + before * F.col("unit")
    end = begin + F.char_length("part") * F.col("unit")
    one = F.size(parts) == 1
    return each.withColumns({"begin": F.when(one, F.col("x0")).otherwise(begin.cast("long")), "end": F.when(one, F.col("x1")).otherwise(end.cast("long"))}).withColumns({"x0": F.col("begin"), "x1": F.col("end"), "word": F.col("part")}).drop("unit", "begin", "end", "part", parts)


def placed(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Horizontal squeeze, in hundredths, of a word set at its own place: its room over the width it needs, within 70 and 100.

    The room goes up to 0.15 sizes before the next word; a line's last word has
    its own width and a tenth, and a tenth of its size.  Without room or need
    nothing is squeezed.
    """
    nxt = F.lead("x0").over(Window.partitionBy(*line).orderBy("word_no"))
    room = F.coalesce(nxt - F.col("x0") - F.col("x_size") * 0.15, (F.col("x1") - F.col("x0")) * 1.1 + F.col("x_size") * 0.1)
    squeeze = F.least(F.lit(100.0), F.greatest(F.lit(70.0), 100 * room / F.col("need")))
    return words.withColumn("squeeze", F.when((room > 0) & (F.col("need") > 0), squeeze).otherwise(100.0))


def readable(word: Column, conf: Column, tentative: Column) -> Column:
    """Whether recovered text can be read: sure enough, or tentative and an alphabetic word of two letters or more once punctuation is off.

    Tentative words should also pass ``left_semi`` against the lexicon's forms.
    """
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return ((conf >= 60) & word.rlike(WORD_CHAR)) | (tentative & T.alphabetic(bare) & (F.char_length(bare) >= 2))


def inside_figures(words: DataFrame, line: list[str] = LINE) -> DataFrame:
    """Words read inside figures that are text: sure, plausible, two characters or more, in lines of two such words with a mean confidence of 80."""
    bare = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    fine = words.where((F.col("conf") >= 70) & (F.char_length(bare) >= 2) & plausible(F.col("word")) & F.col("word").rlike(WORD_CHAR))
    w = Window.partitionBy(*line)
    told = fine.withColumns({"n": F.count(F.lit(1)).over(w), "sure": F.sum("conf").over(w)})
    return told.where((F.col("n") >= 2) & (F.col("sure") >= 80 * F.col("n"))).drop("n", "sure")


def shows_original(word: Column, conf: Column, edited: Column) -> Column:
    """Whether the page's own pixels are shown in place of a word: unsure, not alphabetic, in a block nobody edited."""
    bare = F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return ~edited & (conf < 30) & ~T.alphabetic(bare)


def proper(core: Column) -> Column:
    """A capitalised word, hyphens apart."""
    return core.rlike(r"^\p{Lu}[\p{L}-]*$")
