"""Joins between boxes.  All have the page as an equality key, so Spark hashes or
sorts by page and tests the boxes within; nothing is ever crossed over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as G

PAGE = "doc_id"


def _on(a: DataFrame, b: DataFrame, test: Column, page: str, how: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), (F.col(f"a.{page}") == F.col(f"b.{page}")) & test, how)


def outside(items: DataFrame, areas: DataFrame, page: str = PAGE) -> DataFrame:
    """Items whose centre lies in no area."""
    return _on(items, areas, G.center_in(G.box("a."), G.box("b.")), page, "left_anti")


def inside(items: DataFrame, areas: DataFrame, page: str = PAGE) -> DataFrame:
    """Items whose centre lies in an area."""
    return _on(items, areas, G.center_in(G.box("a."), G.box("b.")), page, "left_semi")


def flagged(items: DataFrame, areas: DataFrame, key: list[str], page: str = PAGE, **flags: str | None) -> DataFrame:
    """All items, each flag telling whether their centre lies in an area, or in one for which the named column holds.

    ``key`` (the page and what tells its items apart) groups an item's areas
    again; both steps are partitioned by page, so items are shuffled once,
    whatever the number of flags.
    """
    both = _on(items, areas, G.center_in(G.box("a."), G.box("b.")), page, "left")
    held = F.col(f"b.{page}").isNotNull()
    told = [F.coalesce(F.bool_or(held if c is None else held & F.col(f"b.{c}")), F.lit(False)).alias(n) for n, c in flags.items()]
    rest = [F.first(f"a.{c}").alias(c) for c in items.columns if c not in key]
    return both.groupBy(*[F.col(f"a.{k}").alias(k) for k in key]).agg(*rest, *told).select(*items.columns, *flags)


def uncovered(items: DataFrame, areas: DataFrame, num: int, den: int, page: str = PAGE) -> DataFrame:
    """Items of which no area covers more than num/den."""
    return _on(items, areas, G.covers(G.box("b."), G.box("a."), num, den), page, "left_anti")


def covered(items: DataFrame, areas: DataFrame, num: int, den: int, page: str = PAGE) -> DataFrame:
    """Items of which an area covers more than num/den."""
    return _on(items, areas, G.covers(G.box("b."), G.box("a."), num, den), page, "left_semi")


def outermost(items: DataFrame, num: int = 4, den: int = 5, page: str = PAGE) -> DataFrame:
    """Items that no strictly larger one covers by more than num/den; one pass, dropped items still drop others."""
    a, b = G.box("a."), G.box("b.")
    return _on(items, items, (G.area(b) > G.area(a)) & G.covers(b, a, num, den), page, "left_anti")


def first_strip(items: DataFrame, strips: DataFrame, slack: int, key: list[str], page: str = PAGE, order: str = "strip") -> DataFrame:
    """Items with the first strip (top, bottom, order) whose span, grown by ``slack``, holds their middle height."""
    middle = F.col("a.y0") + F.col("a.y1")
    both = _on(items, strips, middle.between((F.col("b.top") - slack) * 2, (F.col("b.bottom") + slack) * 2), page, "inner")
    found = both.groupBy(*[F.col(f"a.{k}") for k in key]).agg(F.min(f"b.{order}").alias(order))
    return items.join(found, key)


def hit(points: DataFrame, boxes: DataFrame, slack: int, page: str = PAGE) -> DataFrame:
    """(point, kind, idx): the smallest box that holds each point (``block`` boxes grown by ``slack``), ties by kind, then index."""
    grow = F.when(F.col("b.kind") == "block", slack).otherwise(0)
    test = F.col("a.x").between(F.col("b.x0") - grow, F.col("b.x1") + grow) & F.col("a.y").between(F.col("b.y0") - grow, F.col("b.y1") + grow)
    best = F.min(F.struct(G.area(G.box("b.")).alias("area"), F.col("b.kind").alias("kind"), F.col("b.idx").alias("idx"))).alias("best")
    return _on(points, boxes, test, page, "inner").groupBy(F.col(f"a.{page}"), "a.point").agg(best).select(page, "point", "best.kind", "best.idx")


def insert_before(blocks: DataFrame, fresh: DataFrame, page: str = PAGE) -> DataFrame:
    """Fresh blocks with ``at``: the place of the first block that lies lower on the page, or the number of blocks."""
    ends = blocks.groupBy(page).agg(F.count(F.lit(1)).alias("n"))
    lower = _on(fresh, blocks, F.col("b.y0") > F.col("a.y0"), page, "inner").groupBy(F.col(f"a.{page}"), "a.fresh").agg(F.min("b.block").alias("before"))
    return fresh.join(lower, [page, "fresh"], "left").join(ends, page, "left").withColumn("at", F.coalesce("before", "n", F.lit(0).cast("long"))).drop("before", "n")


def reading_order(blocks: DataFrame, cells: DataFrame, page: str = PAGE) -> DataFrame:
    """(page, kind, id, place): blocks in their order, each table's cells before the first block that begins no higher than the table.

    cells have table_no and top (their table's upper edge); tables go from top to
    bottom, cells by rows of ten pixels, then from the left.
    """
    tables = cells.groupBy(page, "table_no").agg(F.min("top").alias("top"))
    first = _on(tables, blocks, F.col("b.y0") >= F.col("a.top"), page, "inner").groupBy(F.col(f"a.{page}"), "a.table_no").agg(F.min("b.block").alias("before"))
    # a table never goes before one that is higher: the latest place so far
    tables = tables.join(first, [page, "table_no"], "left").withColumn("before", F.coalesce("before", F.lit(2**40)))
    tables = tables.withColumn("before", F.max("before").over(Window.partitionBy(page).orderBy("top", "table_no").rowsBetween(Window.unboundedPreceding, 0)))
    own = blocks.select(page, F.lit("block").alias("kind"), F.col("block").alias("id"), F.col("block").alias("k1"), F.lit(1).alias("k2"), F.lit(0).cast("long").alias("k3"), F.lit(0).cast("long").alias("k4"), F.lit(0).cast("long").alias("k5"), F.lit(0).cast("long").alias("k6"))
    rows = F.floor(F.col("y0") / 10)
    celled = cells.drop("top").join(tables, [page, "table_no"]).select(page, F.lit("cell").alias("kind"), F.col("cell").alias("id"), F.col("before").alias("k1"), F.lit(0).alias("k2"), F.col("top").alias("k3"), F.col("table_no").alias("k4"), rows.alias("k5"), F.col("x0").alias("k6"))
    order = Window.partitionBy(page).orderBy("k1", "k2", "k3", "k4", "k5", "k6", "id")
    return own.union(celled).withColumn("place", F.row_number().over(order).cast("long") - 1).select(page, "kind", "id", "place")


def largest(items: DataFrame, k: int, key: list[str], page: str = PAGE) -> DataFrame:
    """The k largest boxes of each page, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(page).orderBy(G.area(G.box()).desc(), *key))
    return items.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def text_shaped(b: G.Box, size: Column) -> Column:
    """Whether a box has the shape of a line or a few lines of text of this size."""
    w, h = b[2] - b[0], b[3] - b[1]
    return ((h * 10 <= size * 26) & (w * 2 >= h * 3)) | ((h <= size * 6) & (w * 2 >= h * 5))


def uses_background(setting: Column, decorative: Column, has_raw: Column) -> Column:
    """Whether the page's image stands behind its text: asked for, or left to choose and the page is decorated."""
    return has_raw & ((setting == "on") | ((setting == "auto") & decorative))


def outermost_lines(lines: DataFrame, page: list[str], w: str = "w", h: str = "h") -> DataFrame:
    """(page, side, line, distance): of the nearly upright and nearly level lines (x0, y0, x1, y1, ``line``) the outermost on each side.

    A line leans by less than 8 %, lies within 15 % of the page from its side and
    no nearer than three pixels; ties go to the smaller line.
    """
    wide, high = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    upright = F.when(x * 2 < F.col(w), F.struct(F.lit("left").alias("side"), x.alias("d"), F.col(w).alias("of"))).otherwise(F.struct(F.lit("right").alias("side"), (F.col(w) - x).alias("d"), F.col(w).alias("of")))
    level = F.when(y * 2 < F.col(h), F.struct(F.lit("top").alias("side"), y.alias("d"), F.col(h).alias("of"))).otherwise(F.struct(F.lit("bottom").alias("side"), (F.col(h) - y).alias("d"), F.col(h).alias("of")))
    told = lines.withColumn("at", F.when(wide * 100 < high * 8, upright).when(high * 100 < wide * 8, level)).where("at.d >= 3 and at.d * 100 <= at.of * 15")
    best = told.groupBy(*page, F.col("at.side").alias("side")).agg(F.min(F.struct("at.d", "line")).alias("m"))
    return best.select(*page, "side", "m.line", F.col("m.d").cast("double").alias("distance"))
