"""Order-dependent operators: each page (or text block) is a group, folded in order by an Arrow or pandas function.

What one step decides changes what the next one sees, so no join or window gives
the same result.  Groups are single pages; none grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAGE = "doc_id"


def shares(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """How much of each inner box (columns) each outer box (rows) covers; boxes are rows x0, y0, x1, y1."""
    low, high = np.maximum(outer[:, None, :2], inner[None, :, :2]), np.minimum(outer[:, None, 2:], inner[None, :, 2:])
    common = np.clip(high - low, 0, None).prod(axis=2)
    return common / np.maximum((inner[:, 2:] - inner[:, :2]).prod(axis=1), 1)[None]


BOX = ["x0", "y0", "x1", "y1"]


def claim_cells(pdf: pd.DataFrame, most: float = 0.85, taken: float = 0.5) -> pd.DataFrame:
    """Of one page's tables and cells: those that stay when small tables claim their cells first.

    Rows have table_no, cell_no, the cell's x0..y1, the table's area and the
    page's.  Tables over ``most`` of the page are no tables; a cell of which a
    claimed cell covers more than ``taken`` goes; a table needs two cells left,
    and only then claims them.
    """
    rows = pdf.sort_values(["table_area", "table_no", "cell_no"])
    rows = rows[rows["table_area"] <= most * rows["page_area"]]
    box = rows[BOX].to_numpy(dtype=float)
    covered, claimed = shares(box, box) > taken, np.zeros(len(rows), dtype=bool)
    for own in rows.groupby("table_no", sort=False).indices.values():
        free = own[~covered[claimed][:, own].any(axis=0)]
        claimed[free] = len(free) > 1
    return pdf.loc[sorted(rows.index[claimed])]


def claimed_tables(cells: DataFrame, page: str = PAGE) -> DataFrame:
    return cells.groupBy(page).applyInPandas(lambda pdf: claim_cells(pdf), cells.schema)


def assign_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds ``column`` to one paragraph's segments (line_no, seg_no, x0, x1).

    A segment joins the column with the largest positive overlap that does not
    end on its own line; columns widen as they grow, the earlier wins a tie.
    """
    pdf = pdf.sort_values(["line_no", "seg_no"])
    columns: list[list[int]] = []
    out = []
    for r in pdf.itertuples():
        best, widest = None, 0
        for i, (x0, x1, line) in enumerate(columns):
            shared = min(x1, r.x1) - max(x0, r.x0)
            if line != r.line_no and shared > widest:
                best, widest = i, shared
        if best is None:
            columns.append([r.x0, r.x1, r.line_no])
            out.append(len(columns) - 1)
        else:
            x0, x1, _ = columns[best]
            columns[best] = [min(x0, r.x0), max(x1, r.x1), r.line_no]
            out.append(best)
    return pdf.assign(column=pd.array(out, dtype="int64"))


def column_groups(segments: DataFrame, paragraph: list[str]) -> DataFrame:
    schema = ", ".join([*(f"{n} {t}" for n, t in segments.dtypes), "column long"])
    return segments.groupBy(*paragraph).applyInPandas(assign_columns, schema)


def rejoin(words: pd.DataFrame, size: float, syllables: frozenset[str]) -> pd.DataFrame:
    """One line's words from the left: neighbours that are one reading twice, or halves of a syllable, become one word.

    Twice: the same text less than half a size apart, with the larger confidence.
    Halves: less than 0.12 sizes apart, letters where they meet, and together a
    known syllable; the smaller confidence counts.  The box covers both.
    """
    out: list[dict] = []
    for w in words.sort_values(["x0", "word_no"], kind="stable").to_dict("records"):
        last = out[-1] if out else None
        gap = w["x0"] - last["x1"] if last else np.inf
        whole = (last["word"] if last else "") + w["word"]
        twice = gap < 0.5 * size and last["word"] == w["word"]
        if twice or (gap < 0.12 * size and last["word"][-1:].isalpha() and w["word"][:1].isalpha() and whole.strip(".,;:!?").lower() in syllables):
            last.update({c: (min if c in BOX[:2] else max)(last[c], w[c]) for c in BOX})
            last.update(word=last["word"] if twice else whole, conf=(max if twice else min)(last["conf"], w["conf"]))
        else:
            out.append(w)
    return pd.DataFrame(out, columns=words.columns)


def merge_fresh(pdf: pd.DataFrame, gap: float = 4.0, syllables: frozenset[str] = frozenset()) -> pd.DataFrame:
    """One page's words, fresh runs of them (``fresh`` and their own line_no) joining the first existing line that they lie on.

    A run joins a line with a baseline within half its size and no more than
    ``gap`` sizes away sideways.  A fresh word that doubles a word of the line
    (same text, left edges within 1.5 sizes) widens its box; one that a word
    overlaps by more than a tenth is dropped; the others enter, and the line's
    words are re-joined.  A run without a line keeps its words, on line -1.
    ``page_size`` is the size that counts, if there, else the line's x_size.
    """
    old, fresh = pdf[~pdf["fresh"]], pdf[pdf["fresh"]]
    lines = {no: part.copy() for no, part in old.groupby("line_no")}
    for_size = "page_size" if "page_size" in pdf.columns else "x_size"
    lost = []
    runs = sorted((part for _, part in fresh.groupby("line_no")), key=lambda part: (part["baseline"].iloc[0], part["x0"].min()))
    for run in runs:
        for no, line in lines.items():
            size = line[for_size].iloc[0]
            apart = max(run["x0"].min() - line["x1"].max(), line["x0"].min() - run["x1"].max())
            if abs(line["baseline"].iloc[0] - run["baseline"].iloc[0]) <= 0.5 * size and apart <= gap * size:
                break
        else:
            lost.append(run.assign(line_no=-1))
            continue
        twin = (run["word"].to_numpy()[:, None] == line["word"].to_numpy()[None]) & (np.abs(run["x0"].to_numpy()[:, None] - line["x0"].to_numpy()[None]) < 1.5 * size)
        hit = shares(line[BOX].to_numpy(dtype=float), run[BOX].to_numpy(dtype=float)).max(axis=0) > 0.1
        for i, j in [(i, int(row.argmax())) for i, row in enumerate(twin) if row.any()]:
            at, r = line.index[j], run.iloc[i]
            line.loc[at, BOX] = [min(line.at[at, "x0"], r["x0"]), min(line.at[at, "y0"], r["y0"]), max(line.at[at, "x1"], r["x1"]), max(line.at[at, "y1"], r["y1"])]
        enter = run[~twin.any(axis=1) & ~hit].assign(line_no=no)
        lines[no] = rejoin(pd.concat([line, enter]), size, syllables)
    out = pd.concat([*lines.values(), *lost]) if lines or lost else pdf
    return out.astype(pdf.dtypes.to_dict())[pdf.columns.tolist()]


def merged_words(words: DataFrame, page: str = PAGE, gap: float = 4.0, syllables: Iterable[str] = ()) -> DataFrame:
    """merge_fresh page by page; ``syllables`` (a dictionary, which does not grow with the pages) go along."""
    known = frozenset(syllables)
    return words.groupBy(page).applyInPandas(lambda pdf: merge_fresh(pdf, gap, known), words.schema)


def insert_all(pdf: pd.DataFrame) -> pd.DataFrame:
    """One page's blocks in order, fresh ones (by ``fresh`` ordinal, null for others) put before the first block that lies lower; later ones see earlier ones."""
    rows = pdf.to_dict("records")
    order = sorted((r for r in rows if pd.isna(r["fresh"])), key=lambda r: r["block"])
    for r in sorted((r for r in rows if not pd.isna(r["fresh"])), key=lambda r: r["fresh"]):
        at = next((i for i, b in enumerate(order) if b["y0"] > r["y0"]), len(order))
        order.insert(at, r)
    return pd.DataFrame([{**r, "block": i} for i, r in enumerate(order)], columns=pdf.columns)


def inserted(blocks: DataFrame, page: str = PAGE) -> DataFrame:
    return blocks.groupBy(page).applyInPandas(insert_all, blocks.schema)
