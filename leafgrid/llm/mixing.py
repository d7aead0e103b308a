"""Mixing sources to target weights.

Every document gets a random key (a hash of its id), sources are range-sorted
by key, and prefix sums of word counts say which documents a source's budget
reaches.  Keys are uniform, so their leading digits (more of them for more rows)
cut each source into equal ranges without sampling: sums per range, a running sum over the ranges of a
source, and a running sum within each range give every document's place, and a
source with a third of all rows spreads over as many ranges as any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid.llm import common

#: Rows that a range of keys is meant to have if all rows were of one source; 4,096 ranges for each source at least.
RANGE_ROWS = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of ``percent`` hundredths of all sizes by weight, ``most`` times the source's size at most.

    Sources in code-point order, null last, weigh ``weights`` in turn.  What a
    full source can't take goes to the others by weight, until none is above its
    limit.  Sources that fill up do so in the order of limit by weight, so this is
    one pass over the sorted sources (a row for each).
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * most)
    by = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * (percent / 100)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level)
    # the first source that stays below its limit at its own level sets the level of all after it
    first = F.first(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return leveled.withColumn("shared", first).select("source", "source_size", F.coalesce(F.col("shared") * F.col("weight"), F.col("limit")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, s, key, range, size, th) per row; s, the source's hash, joins a null like any value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    th = F.xxhash64(text)
    # a third of all rows without an id must not share a key
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("no id "), th.cast("string"))))
    digits = max(3, math.ceil(math.log(max(1, docs.count() / RANGE_ROWS), 16)))
    rows = docs.select(common.packed(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(source_col)).alias("s"), key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), th.alias("th"))
    return rows.withColumn("range", F.substring("key", 1, digits))


def _planned(rows: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """Sized rows with source_size, target and taken."""
    ranges = common.materialize(rows.groupBy("s", "source", "range").agg(F.sum("size").alias("words")), "ranges")
    goals = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most).withColumn("s", F.xxhash64("source")).drop("source")
    begins = ranges.withColumn("begin", F.sum("words").over(Window.partitionBy("s").orderBy("range")) - F.col("words")).select("s", "range", "begin").join(goals, "s")
    within = Window.partitionBy("s", "range").orderBy("key", "id", "size", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(begins, ["s", "range"])
    start = F.col("begin") + F.col("upto") - F.col("size")
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = goal - epochs * F.col("source_size")
    return placed.withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - start)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, taken) per row.

    size: number of words ``[^\\x20\\x09-\\x0D]+``.  A source takes all its
    documents as often as its target holds its size (whole epochs), then its
    documents in key order until the target, rounded down, is met exactly: the
    last of them is taken in part.  taken counts a document's words over all
    epochs.  Keys hash the id, so reruns agree.

    Null texts have size 0.  A null source is a source of its own.  A null id
    has the hash of the text for a key.  Equal ids follow each other by size and
    text; repeated rows are documents of their own, one after another.  An empty
    table gives no rows; other columns are not read.
    """
    rows = common.materialize(_sized(docs, id_col, text_col, source_col).drop("row"), "mix")
    done = _planned(rows, weights, percent, most)
    return done.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), "source", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2) -> DataFrame:
    """The mixed corpus: a document comes once for each whole taking, then cut after the last taken word; columns as given.

    ``n_chars``, if there, follows a cut text.  The rows carry their own plan,
    so each repeated row is taken as often as ``mix`` says of it; which of equal
    rows is the one that is cut makes no difference, so reruns agree.  Rows
    without words (null and empty texts among them) are never taken.  Null ids
    and sources are as in ``mix``; an empty table gives no rows.
    """
    done = _planned(_sized(docs, id_col, text_col, source_col), weights, percent, most).where("taken > 0")
    # whole copies, then the words of a part, 0 for none
    both = done.withColumn("part", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.filter(F.array(F.col("taken") % F.col("size")), lambda x: x > 0))))
    text, whole = F.col("row")[text_col], F.col("part") < 0
    words = F.slice(F.regexp_extract_all(F.when(~whole, text), F.lit(r"(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest("part", F.lit(1)).cast("int"))
    new = {text_col: F.when(whole, text).otherwise(F.array_join(words, ""))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row")["n_chars"]).otherwise(F.length(new[text_col])).cast(dict(docs.dtypes)["n_chars"])
    return both.select(*common.unpacked(docs, **new))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH d AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
      row_number() OVER (ORDER BY source NULLS LAST) AS place, source_size::DOUBLE * 2 AS lim, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
v AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
f AS (SELECT *, first_value(CASE WHEN lvl * weight < lim THEN lvl END IGNORE NULLS) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shared FROM v),
t AS (SELECT source, source_size, coalesce(shared * weight, lim) AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
      sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS start,
      CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM p
"""
