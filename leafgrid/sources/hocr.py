"""hOCR, the nested markup of OCR engines, as flat word rows."""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values -----------------------------------------------------------
PARAGRAPH, WORD = "ocr_par", "ocrx_word"
LINES = {"ocr_line", "ocr_header", "ocr_textfloat", "ocr_caption"}
# ----------------------------------------------------------------------------

SCHEMA = "par_no int, line_no int, word_no int, word string, conf double, x0 int, y0 int, x1 int, y1 int, baseline double, x_size double"
_TYPES = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def title(text: str) -> dict[str, list[str]]:
    """The ``;``-separated properties of an element's title: name to values."""
    return {name: values for name, *values in map(str.split, filter(str.strip, text.split(";")))}


class _Reader:
    """Follows the markup's events: what is open gives each word its place, what closes without words is not counted."""

    def __init__(self, dx: int, dy: int):
        self.shift = np.array([dx, dy, dx, dy])
        self.rows: list[tuple] = []
        self.par = self.line = None
        self.place = [0, 0, 0]

    def box(self, own: dict) -> np.ndarray:
        return np.array([int(v) for v in own["bbox"][:4]])

    def start(self, e: ET.Element) -> None:
        kind = e.get("class")
        if kind == PARAGRAPH and self.par is None:
            self.par, self.place[1:] = e, [0, 0]
        elif kind in LINES and self.par is not None and self.line is None:
            own = title(e.get("title", ""))
            x0, _, x1, y1 = self.box(own) + self.shift
            slope, rise = (float(v) for v in own.get("baseline", "00")[:2])
            height = own["x_size"][0] if own.get("x_size") else int(own["bbox"][3]) - int(own["bbox"][1])
            self.line, self.place[2] = e, 0
            self.of_line = (float(y1 + rise + slope * (x1 - x0) / 2), float(height))

    def end(self, e: ET.Element) -> None:
        if e is self.line:
            self.line = None
            self.place[1] += self.place[2] > 0
        elif e is self.par:
            self.par = None
            self.place[0] += self.place[1] > 0
        elif self.line is not None and e.get("class") == WORD:
            text = unicodedata.normalize("NFC", "".join(e.itertext())).strip()
            if text:
                own = title(e.get("title", ""))
                conf = float(own.get("x_wconf", "0")[0])
                self.rows.append((*self.place, text, conf, *(self.box(own) + self.shift).tolist(), *self.of_line))
                self.place[2] += 1


def parse(text: str, dx: int = 0, dy: int = 0) -> list[tuple]:
    """Word rows in the order of SCHEMA; words without text, and lines and paragraphs without words, are left out and not counted.

    Text is composed and stripped.  A missing confidence is 0, a missing size the
    line's height; the baseline is taken at the line's middle.  One pass over the
    markup's events.
    """
    reader, events = _Reader(dx, dy), ET.XMLPullParser(("start", "end"))
    events.feed(text.encode())
    events.close()
    for event, element in events.read_events():
        getattr(reader, event)(element)
    return reader.rows


def words(pages: DataFrame, key: str = "page_id", text: str = "hocr") -> DataFrame:
    """(key, words of SCHEMA, error): a page that can't be parsed gives one row with the error and no word."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [_TYPES[f.split()[1]] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, markup in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    rows += [(page, *w, None) for w in parse(markup)] if markup is not None else []
                except (ET.ParseError, KeyError, ValueError) as problem:
                    rows.append((page, *[None] * len(names), str(problem)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([b.schema.field("key").type, *kinds, pa.string()])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *names, "error"])

    base = pages.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return base.mapInArrow(run, f"key {dict(base.dtypes)['key']}, {SCHEMA}, error string").withColumnRenamed("key", key)
