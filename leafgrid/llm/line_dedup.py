"""Line dedup: a line that several documents hold stays in the first of them only.

Line hashes are range-partitioned by (hash, document, position) and sorted, so
the first row of a hash names its owner; a streaming pass over each partition
marks every later document's lines.  The range goes down to the position, hence
a line held by a third of all documents spreads over many partitions.  A
partition that begins inside such a run can't know the owner, so it sets the
first document's lines aside, and the runs that end the partitions before it
(one row per partition) settle them.  Decisions travel as compressed bitmaps
per document, never as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgrid.llm import common

_STREAM = "kind int, h1 long, h2 long, doc long, th long, pos int"
_NAMES = ["kind", "h1", "h2", "doc", "th", "pos"]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h1, h2, doc, th, pos): kind 0, lines to drop; 1, lines that the owner's partition decides; 2, the partition's last run."""
    key, owner, first = None, None, True

    def rows(kind: int, cols: dict, mask: np.ndarray) -> pa.RecordBatch:
        n = int(mask.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32))] + [pa.array(cols[c][mask]) for c in _NAMES[1:]], names=_NAMES)

    for b in batches:
        if not b.num_rows:
            continue
        c = {x: b.column(x).to_numpy(zero_copy_only=False) for x in _NAMES[1:]}
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
        here = (c["h1"][0], c["h2"][0])
        new[0] = key is None or here != key
        start = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: the run carried over from the batch before
        owners = np.concatenate([[c["doc"][0] if owner is None else owner], c["doc"][start]])[run]
        opening = (run <= (1 if key is None else 0)) & first
        later = c["doc"] != owners
        for kind, mask in ((0, later), (1, opening & ~later)):
            if mask.any():
                yield rows(kind, c, mask)
        first = first and bool(opening[-1])
        key, owner = (c["h1"][-1], c["h2"][-1]), owners[-1]
    if key is not None:
        yield rows(2, {"h1": np.array([key[0]]), "h2": np.array([key[1]]), "doc": np.array([owner]), "th": np.zeros(1, np.int64), "pos": np.zeros(1, np.int32)}, np.ones(1, bool))


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series) -> pd.Series:
    def one(at: np.ndarray) -> bytes:
        keep = np.ones(-(-(int(max(at)) + 1) // 8) * 8, dtype=bool)
        keep[np.asarray(at, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return dropped.map(one)


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str | None, b: bytes | None) -> str | None:
        if b is None:
            return t
        lines = (t or "").split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))
        return "\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Per document that loses lines: doc_id, text_hash, n_dropped, bitmap.

    The bitmap is zlib-compressed, a bit per line (1: stays), first line at the
    highest bit; lines beyond its end stay.  Text is split at \\n; a line's key
    has ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased.  Keys
    of at least ``min_chars`` code points that two documents hold lose their
    lines everywhere but in the smallest id holding them, where all stay.

    Rows without text have one empty line.  Rows that share an id are one
    document (its own repeats never count against it); decisions are kept per id
    and text.  Rows with a null id own nothing and lose nothing.  An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = common.ascii_lower(F.btrim("line", F.lit(common.BLANKS)))
    keyed = lines.select("doc", "th", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc", "th", "pos")
    # the range partitioning samples its input; lines are cut and hashed once
    hashed = common.materialize(hashed, "hashes")
    order = ["h1", "h2", "doc", "th", "pos"]
    found = common.materialize(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _STREAM), "lines")
    ended = found.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    settled = found.where("kind = 1").join(ended, ["h1", "h2"]).where("doc > owner")
    dropped = found.where("kind = 0").select("doc", "th", "pos").union(settled.select("doc", "th", "pos"))
    # repeated rows give each decision several times
    per = dropped.groupBy("doc", "th").agg(F.collect_set("pos").alias("at"))
    return per.select(F.col("doc").alias(id_col), F.col("th").alias("text_hash"), F.size("at").cast("long").alias("n_dropped"), _bitmap("at").alias("bitmap"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents with dropped lines taken out of the text; columns n_lines, n_dropped and kept_text are added (replaced if there)."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars).select(F.col(id_col).alias("id"), "text_hash", "n_dropped", "bitmap")
    filled = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(common.packed(docs), F.col(id_col).cast("long").alias("own"), F.xxhash64(filled).alias("hash"))
    both = own.join(maps, (F.col("own") == F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    text, bits = F.col("row")[text_col], F.col("bitmap")
    kept = F.when(bits.isNull(), text).otherwise(_apply(F.when(bits.isNotNull(), text), bits))
    n = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long")
    return both.select(*common.unpacked(docs, n_lines=n, n_dropped=F.coalesce("n_dropped", F.lit(0).cast("long")), kept_text=kept))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, d.owner IS NOT NULL AND k.doc_id <> d.owner AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
