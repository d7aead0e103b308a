"""Accuracy of recognised text against the truth, and character statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import text as T


def word_recall(truth: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, common, n_truth, n_got): sizes of the word multisets and of their intersection; ``text`` holds the words."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(T.tokens(F.col("text"))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias(name))

    both = counted(truth, "a").join(counted(got, "b"), [key, "word"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.groupBy(key).agg(F.sum(F.least(a, b)).alias("common"), F.sum(a).alias("n_truth"), F.sum(b).alias("n_got"))


def missing_words(truth: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Word rows that truth has more often than got, as often as that."""

    def rows(df: DataFrame) -> DataFrame:
        return df.select(key, F.explode(T.tokens(F.col("text"))).alias("word"))

    return rows(truth).exceptAll(rows(got))


def character_errors(pairs: DataFrame, key: str) -> DataFrame:
    """(key, edits, size) of (truth, got)."""
    return pairs.select(key, F.levenshtein("truth", "got").cast("long").alias("edits"), F.char_length("truth").cast("long").alias("size"))


def character_classes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Letters, digits, upper-case letters and words of each text."""
    c = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        key, F.regexp_count(c, F.lit(r"\p{L}")).cast("long").alias("letters"), F.regexp_count(c, F.lit(r"\p{Nd}")).cast("long").alias("digits"),
        F.regexp_count(c, F.lit(r"\p{Lu}")).cast("long").alias("capitals"), F.size(T.tokens(c)).cast("long").alias("words"),
    )


def first_k(rows: DataFrame, key: list[str], order: list[str], k: int = 30) -> DataFrame:
    """The first k rows of each key, for a report, with their rank."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
