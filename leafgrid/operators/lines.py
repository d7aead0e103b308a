"""Operators on lines and blocks: islands, alignment, weight, size, headings, outline, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = "doc_id"


def islands(lines: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``block_no`` within each column group: lines by baseline, parted by wide pitches or differing sizes.

    A pitch over 2.2 sizes parts, as does one over both 1.7 sizes and 1.45 times
    the group's smallest pitch, and a ratio of sizes over 1.3; size is the larger
    of the two lines'.
    """
    w = Window.partitionBy(*group).orderBy("baseline", "line_no")
    told = lines.withColumns({"pitch": F.col("baseline") - F.lag("baseline").over(w), "before": F.lag("x_size").over(w)})
    told = told.withColumn("least", F.min("pitch").over(Window.partitionBy(*group)))
    x = F.greatest("x_size", "before")
    wide = F.col("pitch") * 100 > F.greatest(170 * x, 145 * F.col("least"))
    parts = (F.col("pitch") * 10 > x * 22) | wide | (x * 10 > F.least("x_size", "before") * 13)
    return told.withColumn("block_no", F.sum(F.when(parts, 1).otherwise(0)).over(w)).drop("pitch", "before", "least")


def block_order(blocks: DataFrame, page: str = PAGE) -> DataFrame:
    """Adds ``place``: blocks by rows (top over size, halves to even), then from the left."""
    w = Window.partitionBy(page).orderBy(F.bround(F.col("y0") / F.col("x_size")), "x0", "block")
    return blocks.withColumn("place", F.row_number().over(w).cast("long") - 1)


def bold_share(words: DataFrame, block: list[str], num: int = 3, den: int = 5) -> DataFrame:
    """Whether a block is bold: bold words hold num/den of its characters or more."""
    size = F.char_length("word")
    agg = words.groupBy(*block).agg(F.sum(F.when(F.col("bold"), size).otherwise(0)).alias("b"), F.sum(size).alias("a"))
    return agg.select(*block, ((F.col("b") * den >= F.col("a") * num) & (F.col("a") > 0)).alias("bold"))


def mark_bold(words: DataFrame, page: str = PAGE, line: str = "line_no") -> DataFrame:
    """Adds ``bold`` from ``ratio`` (stroke width over size, in thousandths; 0: none measured).

    The page's reference is the 30th percentile over measured words of three
    characters or more, five at least; without them nothing is bold.  Lines of
    single characters: bold above 1.6 references.  Else a line's words of two
    characters or more decide: three or more measured ones with even strokes
    settle the whole line by their median (1.25); if three quarters of them are
    above 1.25, all of the line is bold; if not, a word above 1.25 is bold, but
    one below 1.3 only beside another.  Limits have a slack of 1e-6 against the
    rounding of percentiles.
    """
    long, measured = F.col("chars") >= 2, F.col("ratio") > 0
    told = words.withColumn("chars", F.char_length("word"))
    ref = told.where((F.col("chars") >= 3) & measured).groupBy(page).agg(F.percentile("ratio", F.lit(0.3)).alias("ref"), F.count(F.lit(1)).alias("samples")).where("samples >= 5").drop("samples")
    w = Window.partitionBy(page, line)
    sure = F.when(long & measured, F.col("ratio"))

    def above(c: Column, limit: float) -> Column:
        return F.coalesce(c > limit * F.col("ref") + 1e-6, F.lit(False))

    told = told.join(ref, page, "left").withColumn("raw", above(F.col("ratio"), 1.25))
    told = told.withColumns({
        "long": F.count(F.when(long, 1)).over(w), "heavy": F.count(F.when(long & F.col("raw"), 1)).over(w),
        "n": F.count(sure).over(w), "middle": F.median(sure).over(w), "spread": F.max(sure).over(w) - F.min(sure).over(w),
    })
    o = w.orderBy("word_no")
    beside = F.coalesce(F.lag("raw").over(o), F.lit(False)) | F.coalesce(F.lead("raw").over(o), F.lit(False))
    weak = F.col("ratio") < 1.3 * F.col("ref") - 1e-6
    bold = (
        F.when(F.col("long") == 0, above(F.col("ratio"), 1.6))
        .when((F.col("n") >= 3) & (F.col("spread") < 0.25 * F.col("middle")), above(F.col("middle"), 1.25))
        .when(F.col("heavy") * 4 >= F.col("long") * 3, True)
        .otherwise(F.col("raw") & (~weak | beside))
    )
    return told.withColumn("bold", F.col("ref").isNotNull() & bold).drop("chars", "ref", "raw", "long", "heavy", "n", "middle", "spread")


def alignment(lines: DataFrame, block: list[str], order: str = "line_no") -> DataFrame:
    """(block, align) from line edges ``x0, x1``, the column's ``c0, c1`` and the block's font size ``px``.

    The tolerance is 0.6 sizes or a hundredth of the column, if that is more.
    One line: centred if its margins are alike (within two tolerances or 4 % of
    the column) and the left one is over 8 % of it; right if the right margin is
    below two tolerances and the left one over 30 %; else left.  More lines: the
    left edges but the first, the right edges but the last, and the centres
    (1.5 tolerances) are straight or not; centred if the centres are and the
    left is not, justified if both edges are, right if only the right one is,
    else left.
    """
    up, down = Window.partitionBy(*block).orderBy(order), Window.partitionBy(*block).orderBy(F.col(order).desc())
    told = lines.withColumns({"first": F.row_number().over(up) == 1, "last": F.row_number().over(down) == 1})

    def spread(c: Column) -> Column:
        return F.max(c) - F.min(c)

    agg = told.groupBy(*block).agg(
        F.count(F.lit(1)).alias("n"), F.max("px").alias("px"), F.greatest(F.max(F.col("c1") - F.col("c0")), F.lit(1)).alias("wide"),
        F.max(F.col("x0") - F.col("c0")).alias("l"), F.max(F.col("c1") - F.col("x1")).alias("r"),
        spread(F.when(~F.col("first"), F.col("x0"))).alias("lefts"), spread(F.when(~F.col("last"), F.col("x1"))).alias("rights"), spread(F.col("x0") + F.col("x1")).alias("centres"),
    )
    # a hundred tolerances, so that whole numbers stay whole
    tol, wide = F.greatest(F.col("px") * 60, F.col("wide")), F.col("wide")
    one = F.when((F.abs(F.col("l") - F.col("r")) * 100 < F.greatest(2 * tol, 4 * wide)) & (F.col("l") * 100 > 8 * wide), "center").when((F.col("r") * 100 < 2 * tol) & (F.col("l") * 100 > 30 * wide), "right").otherwise("left")
    left, right, middle = F.col("lefts") * 100 < tol, F.col("rights") * 100 < tol, F.col("centres") * 100 < 3 * tol
    more = F.when(middle & ~left, "center").when(left & right, "justify").when(right, "right").otherwise("left")
    return agg.select(*block, F.when(F.col("n") == 1, one).otherwise(more).alias("align"))


def font_size(lines: DataFrame, block: list[str]) -> DataFrame:
    """(block, size): the lower weighted median of the lines' estimates, weighted by glyphs, over lines of four glyphs or more.

    estimate is a line's width over its em width, held within 0.75 and 1.3 of
    ``x_size`` / 1.08.  Without such lines the median of sizes counts, else 12.
    """
    natural = F.col("x_size") / 1.08
    told = lines.withColumn("est", F.least(natural * 1.3, F.greatest(natural * 0.75, F.col("width") / F.col("ems"))))
    w = Window.partitionBy(*block).orderBy("est").rowsBetween(Window.unboundedPreceding, 0)
    sure = told.where("glyphs >= 4").withColumns({"upto": F.sum("glyphs").over(w), "all": F.sum("glyphs").over(Window.partitionBy(*block))})
    fitted = sure.where("upto * 2 >= all").groupBy(*block).agg(F.min("est").alias("fit"))
    plain = told.groupBy(*block).agg(F.median("x_size").alias("mid"))
    return plain.join(fitted, block, "left").select(*block, F.coalesce("fit", "mid", F.lit(12.0)).alias("size"))


def body_size(blocks: DataFrame, page: str = PAGE) -> DataFrame:
    """(page, body): the median size with each block counted once for each of its characters."""
    return blocks.where(F.char_length("text") > 0).groupBy(page).agg(F.percentile("size", F.lit(0.5), F.char_length("text")).alias("body"))


def headings(blocks: DataFrame, page: str = PAGE) -> DataFrame:
    """Adds ``level``: 0 for short blocks a quarter larger than the body, 1 for short bold centred ones of three characters or more, else null."""
    told = blocks.join(body_size(blocks, page), page, "left")
    short = (F.col("n_lines") <= 3) & (F.char_length("text") <= 160)
    level = F.when(short & (F.col("size") * 4 >= F.col("body") * 5), 0).when(short & F.col("bold") & (F.col("align") == "center") & (F.char_length("text") >= 3), 1)
    return told.withColumn("level", level.cast("long")).drop("body")


def outline(headings: DataFrame, order: list[str], document: list[str] = ()) -> DataFrame:
    """Level 1 headings before the first of level 0 become level 0; titles have white space collapsed and 120 characters at most."""
    w = Window.partitionBy(*document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max((F.col("level") == 0).cast("int")).over(w)
    title = F.left(F.btrim(F.regexp_replace("text", r"\s+", " ")), F.lit(120))
    return headings.where("level is not null").withColumns({"level": F.when(seen == 0, 0).otherwise(F.col("level")).cast("long"), "title": title})


def pitch(lines: DataFrame, block: list[str]) -> DataFrame:
    """(block, pitch): the median baseline step over half a size, else 1.2 sizes."""
    w = Window.partitionBy(*block).orderBy("baseline")
    step = lines.withColumn("step", F.col("baseline") - F.lag("baseline").over(w))
    return step.groupBy(*block).agg(F.coalesce(F.median(F.when(F.col("step") * 2 > F.col("size"), F.col("step"))), F.max("size") * 1.2).alias("pitch"))


def column_bounds(lines: DataFrame, page: str = PAGE) -> DataFrame:
    """(page, c0, c1): the 10th percentile of left edges and the 90th of right edges."""
    return lines.groupBy(page).agg(F.percentile("x0", F.lit(0.1)).alias("c0"), F.percentile("x1", F.lit(0.9)).alias("c1"))


def in_order(order: str, value: str, glue: str) -> Column:
    """Aggregate: values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), glue)


def export_text(blocks: DataFrame, page: str = PAGE, order: str = "block") -> DataFrame:
    """(page, text): the page's blocks, an empty line between them."""
    return blocks.groupBy(page).agg(in_order(order, "text", "\n\n").alias("text"))


def reflow(blocks: DataFrame, key: list[str], inset: float = 4.0) -> DataFrame:
    """(key, row_no, text) of edited blocks, wrapped to their ``room``; ``em`` is a character's width in sizes.

    Words go to a row while it has room; a word longer than a row stands alone.
    Wrapping sees the row so far, so it is a fold over each block's words.
    """
    limit = (F.col("room") - 2 * inset) / (F.col("size") * F.col("em"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    start = F.array().cast("array<string>")
    rows = F.aggregate(
        words, start,
        lambda a, w: F.when((F.size(a) > 0) & (F.char_length(F.try_element_at(a, F.lit(-1))) + 1 + F.char_length(w) <= limit), F.concat(F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1)), F.array(F.concat(F.try_element_at(a, F.lit(-1)), F.lit(" "), w)))).otherwise(F.concat(a, F.array(w))),
    )
    return blocks.select(*key, F.posexplode(rows).alias("row_no", "text"))


def grown(blocks: DataFrame, margin: float = 36.0) -> DataFrame:
    """Adds ``left`` and ``wide`` (points): where an edited one-line block stands once it has grown to the width it ``need``s.

    Blocks have x (points), room, need, align, page_width, and whether they may
    grow (one line, no container).  The page's margins bound it; a centred block
    grows both ways, a right-aligned one to the left.
    """
    most = F.col("page_width") - 2 * margin
    target = F.least("need", most)
    more = F.when(F.col("grows") & (F.col("need") > F.col("room")), target - F.col("room")).otherwise(0.0)
    shift = F.when(F.col("align") == "center", more / 2).when(F.col("align") == "right", more).otherwise(0.0)
    left = F.least(F.greatest(F.col("x") - shift, F.lit(margin)), F.col("page_width") - margin - target)
    grows = F.col("grows") & (F.col("need") > F.col("room"))
    return blocks.withColumns({"left": F.when(grows, left).otherwise(F.col("x")), "wide": F.when(grows, target).otherwise(F.greatest("room", F.lit(10.0)))})
