"""TrueType fonts: finding them, the widths of their characters, and what embedding them in a PDF needs."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Font:
    """A font file: glyphs by character and their widths in em."""

    data: bytes

    @cached_property
    def tables(self) -> dict[str, bytes]:
        n = struct.unpack(">H", self.data[4:6])[0]
        rows = (struct.unpack(">4sLLL", self.data[12 + 16 * i : 28 + 16 * i]) for i in range(n))
        return {tag.decode("latin-1"): self.data[at : at + size] for tag, _, at, size in rows}

    @cached_property
    def units(self) -> int:
        return struct.unpack(">H", self.tables["head"][18:20])[0]

    @cached_property
    def box(self) -> list[int]:
        """The glyphs' common box and the rise and fall of lines, in thousandths of an em."""
        values = struct.unpack(">4h", self.tables["head"][36:44]) + struct.unpack(">2h", self.tables["hhea"][4:8])
        return [round(v * 1000 / self.units) for v in values]

    @cached_property
    def advances(self) -> np.ndarray:
        """Widths of all glyphs in em; the last of the list is that of all further ones."""
        listed = struct.unpack(">H", self.tables["hhea"][34:36])[0]
        glyphs = struct.unpack(">H", self.tables["maxp"][4:6])[0]
        own = np.frombuffer(self.tables["hmtx"], dtype=">u2", count=2 * listed)[::2].astype(float)
        return np.append(own, np.full(max(0, glyphs - listed), own[-1])) / self.units

    @cached_property
    def glyphs(self) -> dict[int, int]:
        """Glyph by code point, from the map with the most of them that is read here (formats 4 and 12)."""
        raw = self.tables["cmap"]
        maps = []
        for i in range(struct.unpack(">H", raw[2:4])[0]):
            at = struct.unpack(">L", raw[8 + 8 * i : 12 + 8 * i])[0]
            kind = struct.unpack(">H", raw[at : at + 2])[0]
            maps.append(_segments(raw[at:]) if kind == 4 else _groups(raw[at:]) if kind == 12 else {})
        return max(maps, key=len, default={})

    def width(self, text: str) -> float:
        """Width of a text in em; characters without a glyph are as wide as the font's sign for them."""
        return float(sum(self.advances[self.glyphs.get(ord(c), 0)] for c in text))


def _segments(raw: bytes) -> dict[int, int]:
    n = struct.unpack(">H", raw[6:8])[0] // 2
    ends = np.frombuffer(raw, ">u2", n, 14).astype(int)
    starts = np.frombuffer(raw, ">u2", n, 16 + 2 * n).astype(int)
    deltas = np.frombuffer(raw, ">u2", n, 16 + 4 * n).astype(int)
    offsets = np.frombuffer(raw, ">u2", n, 16 + 6 * n).astype(int)
    out = {}
    for i, (a, b, delta, offset) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
        for c in range(a, min(b, 0xFFFE) + 1):
            at = 16 + 6 * n + 2 * i + offset + 2 * (c - a)
            glyph = c if not offset else struct.unpack(">H", raw[at : at + 2])[0]
            if glyph and (glyph + delta) % 65536:
                out[int(c)] = int((glyph + delta) % 65536)
    return out


def _groups(raw: bytes) -> dict[int, int]:
    n = struct.unpack(">L", raw[12:16])[0]
    rows = np.frombuffer(raw, ">u4", 3 * n, 16).reshape(-1, 3).astype(int)
    return {c: int(glyph + c - a) for a, b, glyph in rows.tolist() for c in range(a, b + 1) if glyph + c - a}


def find_font(names: Sequence[str], folders: Sequence[str]) -> str | None:
    """The first of the names in the first folder that has one, whatever the case; else the same in the folders' sub-folders."""
    for pattern in ("*", "**/*"):
        for folder in folders:
            held = {p.name.lower(): p for p in sorted(Path(folder).glob(pattern), reverse=True) if p.is_file()}
            hit = next((held[n.lower()] for n in names if n.lower() in held), None)
            if hit:
                return str(hit)
    return None


@lru_cache(maxsize=8)
def load(path: str) -> Font:
    return Font(Path(path).read_bytes())


def glyph_widths(spark: SparkSession, regular: Font, bold: Font | None = None) -> DataFrame:
    """(char, bold, em): a row for each character and weight; a font's size, whatever the text."""
    rows = [(chr(c), heavy, float(font.advances[g])) for heavy, font in ((False, regular), (True, bold or regular)) for c, g in font.glyphs.items() if not 0xD800 <= c < 0xE000]
    return spark.createDataFrame(rows, "char string, bold boolean, em double")


def text_widths(words: DataFrame, widths: DataFrame, key: list[str], word: str = "word", missing: float = 0.5) -> DataFrame:
    """(key, ems) of word rows with ``bold``: the sum of their characters' widths; a character without a width has ``missing``."""
    each = words.select(*key, "bold", F.explode(F.split(word, "")).alias("char")).where("char <> ''")
    # a font's table, tens of thousands of short rows at most
    told = each.join(F.broadcast(widths), ["char", "bold"], "left")
    sums = told.groupBy(*key).agg(F.sum(F.coalesce("em", F.lit(missing))).alias("ems"))
    return words.select(*key).join(sums, key, "left").select(*key, F.coalesce("ems", F.lit(0.0)).alias("ems"))
