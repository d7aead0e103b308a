"""PDF pages: the page's image below invisible text that can be found and copied, or visible text, pictures and rules.

Invisible text is set with a font that has no glyphs, only a map from codes to
characters, so every script works and nothing is embedded.  Visible text takes
TrueType fonts, which are embedded once for a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from leafgrid.raster.resample import resized
from leafgrid.sources.fonts import Font

_MAP = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Same def /CMapType 2 def
1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap end end"""


def _text(s: str) -> str:
    return "<FEFF" + s.encode("utf-16-be").hex().upper() + ">"


def at_resolution(rgb: np.ndarray, points: float, dpi: float = 220) -> np.ndarray:
    """A picture that is shown ``points`` wide with no more pixels than ``dpi`` gives."""
    most = max(1, int(points / 72 * dpi))
    h, w = rgb.shape[:2]
    return resized(rgb, (most, max(1, int(h * most / w)))) if w > most else rgb


def _embedded(put: Callable[[bytes], int], stream: Callable[[str, bytes], int], font: Font, name: str, used: str) -> int:
    """A Type 0 font object: codes are glyphs, with the widths and the characters of those that are used."""
    glyphs = {font.glyphs[ord(c)]: c for c in sorted(set(used)) if ord(c) in font.glyphs}
    box = font.box
    file = stream(f"/Length1 {len(font.data)}", font.data)
    about = put(f"<< /Type /FontDescriptor /FontName /{name} /Flags 4 /FontBBox [{' '.join(map(str, box[:4]))}] /ItalicAngle 0 /Ascent {box[4]} /Descent {box[5]} /CapHeight {box[4]} /StemV 80 /FontFile2 {file} 0 R >>".encode())
    widths = " ".join(f"{g} [{font.advances[g] * 1000:.0f}]" for g in sorted(glyphs))
    cid = put(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{name} /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 1000 /W [{widths}] /CIDToGIDMap /Identity /FontDescriptor {about} 0 R >>".encode())
    pairs = [f"<{g:04X}> <{c.encode('utf-16-be').hex().upper()}>" for g, c in sorted(glyphs.items())]
    blocks = "".join(f"{len(pairs[i : i + 100])} beginbfchar {' '.join(pairs[i : i + 100])} endbfchar\n" for i in range(0, len(pairs), 100))
    codes = stream("", _MAP.split(b"1 beginbfrange")[0] + blocks.encode() + b"endcmap end end")
    return put(f"<< /Type /Font /Subtype /Type0 /BaseFont /{name} /Encoding /Identity-H /DescendantFonts [{cid} 0 R] /ToUnicode {codes} 0 R >>".encode())


#: Width of the hairline around visible letters, in sizes: thin type gets the weight of print.
INK_SPREAD = 0.028


def document(pages: Sequence[dict], title: str = "", creator: str = "", fonts: Sequence[Font] = ()) -> bytes:
    """PDF bytes of pages.

    A page has width and height (points) and, if there are any: image (rgb bytes,
    w, h) under all of it; pictures (rgb bytes, w, h, x, y, width, height); rules
    (x0, y0, x1, y1, thickness); words (text, x, y, size, squeeze), invisible, or
    with (bold, (r, g, b)) after these, visible in ``fonts`` (regular, bold); and
    outline (level, title) entries.
    """
    bodies: list[bytes] = []

    def put(body: bytes) -> int:
        bodies.append(body)
        return len(bodies)

    def stream(head: str, data: bytes) -> int:
        packed = zlib.compress(data)
        return put(f"<< {head} /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream")

    catalog, tree, names = put(b""), put(b""), put(b"")
    to_unicode = stream("", _MAP)
    info = put(b"<< /Type /FontDescriptor /FontName /Plain /Flags 4 /FontBBox [0 0 1000 1000] /ItalicAngle 0 /Ascent 1000 /Descent 0 /CapHeight 1000 /StemV 80 >>")
    cid = put(f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /FontDescriptor {info} 0 R >>".encode())
    font = put(f"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [{cid} 0 R] /ToUnicode {to_unicode} 0 R >>".encode())
    seen = "".join(w[0] for page in pages for w in page.get("words", ()) if len(w) > 5) + " "
    faces = [_embedded(put, stream, f, f"Face{i}", seen) for i, f in enumerate(fonts)] if len(seen) > 1 else []
    kids, marks = [], []

    def picture(rgb: bytes, w: int, h: int) -> int:
        return stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8", rgb)

    for page in pages:
        shown = [(*page["image"], 0, 0, page["width"], page["height"])] if page.get("image") else []
        shown += list(page.get("pictures", ()))
        images = " ".join(f"/Im{i} {picture(*p[:3])} 0 R" for i, p in enumerate(shown))
        draw = [f"q {w:.3f} 0 0 {h:.3f} {x:.3f} {y:.3f} cm /Im{i} Do Q" for i, (*_, x, y, w, h) in enumerate(shown)]
        draw += [f"{max(0.4, t):.3f} w {a:.3f} {b:.3f} m {c:.3f} {d:.3f} l S" for a, b, c, d, t in page.get("rules", ())]
        for text, x, y, size, squeeze, *face in page.get("words", ()):
            # each word's state is its own: a mode outlives its text object
            place = f"{squeeze:.2f} Tz 1 0 0 1 {x:.3f} {y:.3f} Tm"
            if face and fonts:
                heavy = min(int(bool(face[0])), len(fonts) - 1)
                codes = "".join(f"{fonts[heavy].glyphs.get(ord(c), 0):04X}" for c in text + " ")
                color = " ".join(f"{v:.3f}" for v in ((0, 0, 0) if face[1] is None else face[1]))
                draw.append(f"q {color} rg {color} RG {INK_SPREAD * size:.3f} w BT 2 Tr /V{heavy} {size:.3f} Tf {place} <{codes}> Tj ET Q")
            else:
                draw.append(f"q BT 3 Tr /F {size:.3f} Tf {place} <{(text + ' ').encode('utf-16-be').hex()}> Tj ET Q")
        content = stream("", "\n".join(draw).encode())
        held = " ".join([f"/F {font} 0 R", *(f"/V{i} {f} 0 R" for i, f in enumerate(faces))])
        kid = put(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {page['width']:.3f} {page['height']:.3f}] /Contents {content} 0 R /Resources << /Font << {held} >> /XObject << {images} >> >> >>".encode())
        kids.append(kid)
        marks += [(level, name, kid) for level, name in page.get("outline", ())]
    # an outline entry's parent is the last one of level 0, or the root
    root = put(b"")
    entries = [put(b"") for _ in marks]
    parents, last = [], root
    for (level, _, _), entry in zip(marks, entries, strict=True):
        parents.append(root if level == 0 else last)
        last = entry if level == 0 else last
    children = {p: [e for e, q in zip(entries, parents, strict=True) if q == p] for p in [root, *entries]}
    for (_, name, kid), entry, parent in zip(marks, entries, parents, strict=True):
        row = children[parent]
        at = row.index(entry)
        links = (f" /Prev {row[at - 1]} 0 R" if at else "") + (f" /Next {row[at + 1]} 0 R" if at + 1 < len(row) else "")
        below = children[entry]
        links += f" /First {below[0]} 0 R /Last {below[-1]} 0 R /Count {len(below)}" if below else ""
        bodies[entry - 1] = f"<< /Title {_text(name)} /Parent {parent} 0 R /Dest [{kid} 0 R /Fit]{links} >>".encode()
    top = children[root]
    bodies[root - 1] = (f"<< /Type /Outlines /First {top[0]} 0 R /Last {top[-1]} 0 R /Count {len(top)} >>" if top else "<< /Type /Outlines >>").encode()
    bodies[catalog - 1] = f"<< /Type /Catalog /Pages {tree} 0 R /Outlines {root} 0 R >>".encode()
    bodies[tree - 1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    bodies[names - 1] = f"<< /Title {_text(title)} /Creator {_text(creator)} /Producer (leafgrid) >>".encode()
    out, at = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(bodies, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    begin = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
    out += f"trailer << /Size {len(bodies) + 1} /Root {catalog} 0 R /Info {names} 0 R >>\nstartxref\n{begin}\n%%EOF\n".encode()
    return bytes(out)


def documents(words: DataFrame, doc: str = "doc_id", page: str = "page_no", fonts: Sequence[Font] = (), creator: str = "") -> DataFrame:
    """(doc, pdf, n_pages, n_skipped) from word rows in points: doc, page, width, height, text, x, y, size, squeeze, level (outline level or null).

    With fonts, rows that also have ``bold`` and ``color`` (red, green, blue) are
    visible.  Pages with an ``error`` (if the rows have that column) are left out
    and counted.  One document is one file, so its pages meet in one task;
    documents spread.
    """
    visible = bool(fonts) and {"bold", "color"} <= set(words.columns)
    columns = ["text", "x", "y", "size", "squeeze", *(["bold", "color"] if visible else [])]
    failing = "error" in words.columns

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        key, pages, skipped = pdf[doc].iloc[0], [], 0
        for _, rows in pdf.groupby(page, sort=True):
            if failing and rows["error"].notna().any():
                skipped += 1
                continue
            rows = rows.sort_values(["y", "x"], ascending=[False, True])
            marked = rows[rows["level"].notna()]
            pages.append({"width": rows["width"].iloc[0], "height": rows["height"].iloc[0], "words": list(rows[columns].itertuples(index=False, name=None)), "outline": [(int(v), t) for v, t in zip(marked["level"], marked["text"], strict=True)]})
        return pd.DataFrame({doc: [key], "pdf": [document(pages, str(key), creator, fonts) if pages else None], "n_pages": [len(pages)], "n_skipped": [skipped]})

    return words.groupBy(doc).applyInPandas(make, f"{doc} {dict(words.dtypes)[doc]}, pdf binary, n_pages long, n_skipped long")
