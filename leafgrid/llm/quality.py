"""Quality rules: per-document statistics and cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space collapsed) and hashed; a line
is boilerplate of its host when more distinct documents of the host hold it than
the limit allows.  Such lines are removed, and a document that loses most of its
words, or has too few left, is rejected as depleted.  Where exact copies are
still to be settled by dedup operators, ``texts_once`` counts equal texts as one
document, so a much-copied good text is not taken for boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import common, kernels

#: Defaults of the verdicts; all are parameters of the operator.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_LINE_WORDS, LINE_DOCS, LEFT_PERCENT = 3, 10, 30
#: Lines above the limit that are broadcast (16 bytes each); with more of them the join is salted.
BROADCAST_LINES, SALTS = 1 << 18, 32

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_P = np.uint64(0x100000001B3)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _P, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _line_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each line's sequence of word hashes; first: each line's first word, n + 1 entries."""
    n = np.diff(first)
    if not len(h):
        return np.zeros(len(n), dtype=np.uint64)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(int(n.max()))[place], dtype=np.uint64)])
    return kernels.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines, and each text's first line."""
    cut = np.flatnonzero(data == 10)
    upto = np.searchsorted(cut, at)
    first = upto + np.arange(len(at))
    starts = np.zeros(int(first[-1]), dtype=np.int64)
    ends = np.zeros(int(first[-1]), dtype=np.int64)
    inner = np.ones(len(starts), dtype=bool)
    inner[first[:-1]] = False
    starts[first[:-1]], starts[inner] = at[:-1], cut + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[first[1:] - 1], ends[inner] = at[1:], cut
    return starts, ends, first


def measure(column: pa.Array, min_line_words: int = MIN_LINE_WORDS) -> dict[str, pa.Array]:
    """Of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the distinct normalised lines with their words."""
    data, at = kernels.buffers(column)
    n = len(at) - 1
    starts, ends, first = kernels.words(data, at)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    out = {"n_words": np.diff(first), "word_chars": _sums(lead[ends] - lead[starts], first), "n_symbols": _sums(_SYMBOL[data], at)}

    # lines with a word that equal an earlier one of their text
    lo, hi, per = _lines(data, at)
    inside = np.searchsorted(starts, np.append(lo, len(data)))  # each line's first word
    inside[per[:-1]] = first[:-1]
    count = np.diff(np.append(inside[:-1], first[-1]))
    full = np.flatnonzero(count > 0)
    owner = np.repeat(np.arange(n), np.diff(per))[full]
    raw = kernels.hash_runs(data, lo[full], hi[full])
    order = np.lexsort((raw, owner))
    same = (raw[order][1:] == raw[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=n)

    # words inside 5-word windows that their text has twice
    h, ptr = kernels.shingle_hashes(kernels.hash_runs(data, starts, ends), first)
    whose = np.repeat(np.arange(n), np.diff(ptr))
    wide = np.diff(first)[whose] >= 5
    h, whose, begin = h[wide], whose[wide], (np.arange(len(ptr[whose])) - ptr[whose] + first[whose])[wide]
    mixed = kernels.mix(h + whose.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(starts) + 6, dtype=np.int64)
    np.add.at(step, begin[twice], 1)
    np.add.at(step, begin[twice] + 5, -1)
    out["n_repeat_words"] = _sums(np.cumsum(step)[: len(starts)] > 0, first)
    out = {k: pa.array(v.astype(np.int64)) for k, v in out.items()}

    # normalised lines
    keys = _line_keys(kernels.hash_runs(kernels.LOWER[data], starts, ends), np.append(inside[:-1], first[-1]))[full]
    use = count[full] >= min_line_words
    keys, owner, size = keys[use], owner[use], count[full][use]
    order = np.lexsort((keys, owner))
    keys, owner, size = keys[order], owner[order], size[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(fresh)
    total = np.add.reduceat(size, head) if len(head) else size
    border = pa.array(np.searchsorted(owner[head], np.arange(n + 1)).astype(np.int32))
    out["lines"] = pa.ListArray.from_arrays(border, pa.array(keys[head].view(np.int64)))
    out["line_words"] = pa.ListArray.from_arrays(border, pa.array(total.astype(np.int32)))
    return out


def _strip(text: str, hot: set[int], min_line_words: int) -> str:
    lines = text.split("\n")
    data, at = kernels.buffers(pa.array(lines, pa.large_string()))
    starts, ends, first = kernels.words(data, at)
    keys = _line_keys(kernels.hash_runs(kernels.LOWER[data], starts, ends), first).view(np.int64)
    return "\n".join(x for x, k, n in zip(lines, keys.tolist(), np.diff(first).tolist(), strict=True) if n < min_line_words or k not in hot)


def _hot_of(rows: DataFrame, hot: DataFrame, salt: Column, broadcast_lines: int) -> DataFrame:
    """The rows (host, line, ...) whose line is hot in their host.

    A hot line is a hot key.  Up to ``broadcast_lines`` of them are broadcast,
    so no key gathers; beyond, each stands in SALTS places and its rows are
    dealt over them.
    """
    if hot.count() <= broadcast_lines:
        return rows.join(F.broadcast(hot), ["host", "line"])
    spread = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread.hint("merge"), ["host", "line", "salt"]).drop("salt")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, min_line_words: int = MIN_LINE_WORDS, line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT, texts_once: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """A verdict per row: id, host_hash, text_hash, the base statistics, removed_words, hot_lines, base_failed, kept.

    A line of at least ``min_line_words`` words is removed when more than
    ``line_docs`` documents of its host hold it, however large the host
    (``texts_once``: documents with equal text count once).  A document fails
    when fewer than ``min_words`` words or ``left_percent`` of its words remain.

    Null and empty texts have no words and fail.  A null host is a host of its
    own.  Rows of an id are one document when documents are counted; rows
    without id are one per text.  Repeated rows get equal verdicts.  Empty
    tables give no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in kernels.pieces(b, "text"):
                yield pa.RecordBatch.from_pydict({c: p.column(c) for c in ("id", "host", "th", "doc")} | measure(p.column("text"), min_line_words))

    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # 64 bits of the id, or of the text where there is none, tell documents apart
    doc = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("no id"), th)).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(host_col)).alias("host"), th.alias("th"), doc.alias("doc"), F.col(text_col).alias("text"))
    kind = dict(base.dtypes)["id"]
    shape = f"id {kind}, host long, th long, doc long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
    seen = common.materialize(base.mapInArrow(scan, shape), "quality")
    held = seen.select("host", F.col("th" if texts_once else "doc").alias("one"), F.explode("lines").alias("line"))
    hot = common.materialize(held.groupBy("host", "line").agg(F.count_distinct("one").alias("n")).where(F.col("n") > line_docs).select("host", "line"), "hot")
    each = seen.select("host", "th", "doc", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "th", "doc", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    lost = _hot_of(each, hot, F.col("doc"), broadcast_lines).distinct().groupBy("doc", "host", "th").agg(F.sum("words").alias("gone"), F.collect_list("line").alias("hot"))
    both = seen.join(lost, ["doc", "host", "th"], "left")
    gone = F.coalesce("gone", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - gone
    return both.select(F.col("id").alias(id_col), F.col("host").alias("host_hash"), F.col("th").alias("text_hash"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("removed_words"), F.col("hot").alias("hot_lines"), failed.alias("base_failed"), (~failed & (left >= min_words) & (100 * left >= left_percent * F.col("n_words"))).alias("kept"))


def apply_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: int) -> DataFrame:
    """The kept documents, without the lines above the limit; columns and order of columns as given.

    ``limits`` are those of ``quality``, which also says how nulls, copies and
    repeated rows count; a repeated row is kept as often as it comes.  A text
    loses all its places of a removed line.  An empty table gives no rows.
    """
    words = limits.get("min_line_words", MIN_LINE_WORDS)

    @F.pandas_udf("string")
    def strip(text: pd.Series, hot: pd.Series) -> pd.Series:
        return pd.Series([t if h is None or t is None else _strip(t, set(h.tolist()), words) for t, h in zip(text, hot, strict=True)], dtype=object)

    found = quality(docs, id_col, text_col, host_col, **limits).where("kept").select(F.col(id_col).alias("id"), "host_hash", "text_hash", "hot_lines").dropDuplicates(["id", "host_hash", "text_hash"])
    own = docs.select(common.packed(docs), F.xxhash64(F.col(host_col)).alias("h"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    both = own.join(found, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.col("h") == F.col("host_hash")) & (F.col("t") == F.col("text_hash")))
    text, hot = F.col("row")[text_col], F.col("hot_lines")
    return both.select(*common.unpacked(docs, **{text_col: F.when(hot.isNull(), text).otherwise(strip(F.when(hot.isNotNull(), text), hot))}))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


OP9_SQL = """
WITH w AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
s AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS s FROM i),
r AS (SELECT doc_id, s FROM s GROUP BY doc_id, s HAVING count(*) >= 2),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT s.doc_id, unnest(range(s.i, s.i + 5)) AS p FROM s JOIN r USING (doc_id, s)) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM l),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n WHERE len(ws) > 0 GROUP BY doc_id),
k AS (SELECT doc_id, source, array_to_string(ws, ' ') AS line, len(ws) AS words FROM n WHERE len(ws) >= 3),
f AS (SELECT source, line FROM k GROUP BY source, line HAVING count(DISTINCT doc_id) > 10),
g AS (SELECT k.doc_id, sum(k.words) AS gone FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.line = f.line GROUP BY k.doc_id),
b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(g.gone, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 10 AND 100 * (n_words - removed_words) >= 30 * n_words AS kept, removed_words
FROM v
"""
