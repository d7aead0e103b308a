"""Text functions as column expressions.

Letters, tone marks and confusable shapes of Vietnamese are spelt out below;
normal forms are the one thing Spark has no function for, hence the Arrow UDFs
``nfc`` and ``nfd``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
#: Combining marks of the five tones and three letter shapes.
TONES = "̣̀́̃̉"
SHAPES = "̛̂̆"
#: Where a tone may stand on either of two vowels: first form to canonical form.
PLACEMENTS = {
    "òa": "oà", "óa": "oá", "ỏa": "oả", "õa": "oã", "ọa": "oạ",
    "òe": "oè", "óe": "oé", "ỏe": "oẻ", "õe": "oẽ", "ọe": "oẹ",
    "ùy": "uỳ", "úy": "uý", "ủy": "uỷ", "ũy": "uỹ", "ụy": "uỵ",
}
# ----------------------------------------------------------------------------


def _letters() -> tuple[str, str]:
    """Every lower-case letter that bears only these marks, and the letters below them."""
    marked, plain = "", ""
    for base in "aeiouyn":
        for shape in ("", *SHAPES):
            for tone in ("", *TONES):
                c = unicodedata.normalize("NFC", base + shape + tone)
                if len(c) == 1 and c != base:
                    marked, plain = marked + c, plain + base
    return marked + "đ", plain + "d"


MARKED, PLAIN = _letters()


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def nfd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFD", x))


def skeleton(c: Column) -> Column:
    """Lower case without the eight marks, đ as d; composed text only, no UDF."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def canonical(c: Column) -> Column:
    """Lower case with the tone in its canonical place; the text must be composed (``nfc``)."""
    low = F.lower(c)
    table = F.create_map(*[F.lit(x) for pair in PLACEMENTS.items() for x in pair])
    tail = F.element_at(table, F.right(low, F.lit(2)))
    return F.when(tail.isNotNull(), F.concat(F.left(low, F.char_length(low) - 2), tail)).otherwise(low)


def token_parts(c: Column) -> Column:
    """struct(pre, core, post): what a token has before, between and after its first and last word character."""
    edge = r"[^\p{L}\p{N}\p{M}_]*"
    return F.struct(*[F.regexp_extract(c, rf"(?s)^({edge})(.*?)({edge})$", i + 1).alias(n) for i, n in enumerate(("pre", "core", "post"))])


def match_case(source: Column, word: Column) -> Column:
    """The word in the manner of the source: all capitals (longer than one), first capital, or as it is."""
    caps = (source == F.upper(source)) & (source != F.lower(source)) & (F.char_length(source) > 1)
    head = F.left(source, F.lit(1))
    first = (head == F.upper(head)) & (head != F.lower(head))
    return F.when(caps, F.upper(word)).when(first, F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 2**31 - 1))).otherwise(word)


def replace_first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(new), F.substr(c, at + len(old)))).otherwise(c)


def points_apart(a: Column, b: Column) -> Column:
    """How many different characters only one of two (decomposed) texts has."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    x, y = (F.filter(v, lambda c: c != "") for v in (x, y))
    return F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))


def tokens(c: Column) -> Column:
    """The pieces of a text between runs of white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def alphabetic(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def natural_key(path: Column) -> Column:
    """A sort key in which runs of digits count as numbers, however long, and letters in lower case."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))

    def entry(p: Column) -> Column:
        # numbers without leading zeros are ordered by length, then as text
        number = F.when(p.rlike(r"^\d"), F.regexp_replace(p, r"^0+(?=\d)", ""))
        return F.struct(number.isNotNull().alias("digits"), F.length(number).alias("size"), number.alias("number"), F.lower(p).alias("text"))

    return F.transform(parts, entry)


def edit_within_one(a: Column, b: Column) -> Column:
    """Whether exactly one insertion, deletion or substitution leads from a to b."""
    return F.levenshtein(a, b, 1) == 1


def properties(title: Column) -> Column:
    """A ``;``-separated list of ``key value value`` as a map from keys to arrays of values."""
    entries = F.filter(F.transform(F.split(title, ";"), lambda e: F.filter(F.split(F.btrim(e), r"\s+"), lambda v: v != "")), lambda e: F.size(e) > 0)
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e[0].alias("key"), F.slice(e, 2, F.greatest(F.lit(1), F.size(e))).alias("value"))))


def orientation(report: Column) -> Column:
    """struct(degrees, conf) of an engine's orientation report; (0, 0.0) where it says nothing."""
    degrees = F.regexp_extract(report, r"Rotate: (\d+)", 1).try_cast("int")
    conf = F.regexp_extract(report, r"Orientation confidence: ([\d.]+)", 1).try_cast("double")
    return F.struct(F.coalesce(degrees, F.lit(0)).alias("degrees"), F.coalesce(conf, F.lit(0.0)).alias("conf"))
