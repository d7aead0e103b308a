"""Box arithmetic as column expressions; a box is four columns x0, y0, x1, y1 with y growing downward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The box columns of a table, with an optional ``alias.`` prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap_area(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def covers(outer: Box, inner: Box, num: int, den: int) -> Column:
    """Whether more than num/den of ``inner`` lies in ``outer`` (not symmetric; in whole numbers)."""
    return overlap_area(outer, inner) * den > F.greatest(F.lit(1), area(inner)) * num


def center_in(inner: Box, outer: Box) -> Column:
    """Whether the centre of ``inner`` lies in ``outer``, borders included (doubled coordinates keep it in whole numbers)."""
    x, y = inner[0] + inner[2], inner[1] + inner[3]
    return x.between(outer[0] * 2, outer[2] * 2) & y.between(outer[1] * 2, outer[3] * 2)


def padded(b: Box, by: int, width: Column | None = None, height: Column | None = None) -> Box:
    """The box grown on all sides, clipped to the page where its size is given."""
    x0, y0, x1, y1 = b[0] - by, b[1] - by, b[2] + by, b[3] + by
    if width is not None:
        x0, x1 = F.greatest(F.lit(0), x0), F.least(width, x1)
    if height is not None:
        y0, y1 = F.greatest(F.lit(0), y0), F.least(height, y1)
    return x0, y0, x1, y1


def corners(points: Column) -> Column:
    """Four points as (top left, top right, bottom right, bottom left) by the extremes of x + y and y - x."""
    by_sum = F.array_sort(F.transform(points, lambda p: F.struct((p["x"] + p["y"]).alias("k"), p.alias("p"))))
    by_diff = F.array_sort(F.transform(points, lambda p: F.struct((p["y"] - p["x"]).alias("k"), p.alias("p"))))
    return F.array(by_sum[0]["p"], by_diff[0]["p"], F.element_at(by_sum, -1)["p"], F.element_at(by_diff, -1)["p"])


def crossing(a: Column, b: Column) -> Column:
    """Where two lines a·x + b·y = c meet; null if they are parallel."""
    det = a["a"] * b["b"] - b["a"] * a["b"]
    return F.when(det != 0, F.struct(((a["c"] * b["b"] - b["c"] * a["b"]) / det).alias("x"), ((a["a"] * b["c"] - b["a"] * a["c"]) / det).alias("y")))


def compose(m: Column, n: Column) -> Column:
    """The product of two 3 x 3 matrices held row by row in arrays of nine: first n, then m."""
    return F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: sum((m[(F.floor(i / 3) * 3).cast("int") + k] * n[(i % 3).cast("int") + 3 * k] for k in range(3)), F.lit(0.0)))


def quarter_turn(degrees: int, width: Column, height: Column) -> Column:
    """The exact matrix of a turn by 0, 90, 180 or 270 degrees, clockwise, within the pixel grid."""
    w, h = width - 1, height - 1
    rows = {0: (1, 0, 0, 0, 1, 0), 90: (0, -1, h, 1, 0, 0), 180: (-1, 0, w, 0, -1, h), 270: (0, 1, 0, -1, 0, w)}[degrees % 360]
    return F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in (*rows, 0, 0, 1)])


def page_map(width: Column, height: Column, paper_width: float, paper_height: float, snap: float = 0.12) -> Column:
    """The map from pixels to points of a page on paper: struct(pw, ph, sx, sy, ox, oy).

    The paper turns with a landscape page.  A page whose aspect differs from the
    paper's by no more than ``snap`` fills it, another is fitted and centred.
    The paper's y axis grows upward.
    """
    pw = F.when(width > height, float(max(paper_width, paper_height))).otherwise(float(min(paper_width, paper_height)))
    ph = F.when(width > height, float(min(paper_width, paper_height))).otherwise(float(max(paper_width, paper_height)))
    sx, sy = pw / width, ph / height
    fit = F.least(sx, sy)
    fills = F.abs((sx / sy) - 1) <= snap
    return F.struct(pw.alias("pw"), ph.alias("ph"), F.when(fills, sx).otherwise(fit).alias("sx"), F.when(fills, sy).otherwise(fit).alias("sy"), F.when(fills, 0.0).otherwise((pw - fit * width) / 2).alias("ox"), F.when(fills, 0.0).otherwise((ph - fit * height) / 2).alias("oy"))


def to_points(page: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return page["ox"] + x * page["sx"], page["ph"] - page["oy"] - y * page["sy"]


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of an sRGB colour with parts in 0..255."""

    def linear(c: Column) -> Column:
        v = c / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    """The contrast ratio of two luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
