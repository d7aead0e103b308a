"""A corpus from quality rules to token ids, each stage on all that the one before it kept.

All stages but the last return the columns of their input.  Null texts count as
empty ones, null sources are a source, null ids are carried along; repeated rows
are documents of their own to the rules and the mix, and share the fate of their
id in the dedup stages; an empty table stays empty.  Columns that the stages
don't read, whatever their names, come through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import common, line_dedup, mixing, ngram_join, quality, sentencepiece_codec


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines above their host's limit.

    Copies are still in, so documents of equal text count once: a much-copied
    good text is not taken for boilerplate.  Null and empty texts go.
    """
    return _counted(quality.apply_quality(docs, texts_once=True), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a repeated line stays in its first document only.

    A document may lose all its lines and stay as an empty text.  Documents
    without id keep theirs.
    """
    # without the columns that the operator adds, of which the documents may have their own
    told = line_dedup.dedup_lines(docs.select(common.packed(docs), "doc_id", "text"))
    return _counted(told.select(*common.unpacked(docs, text=F.col("kept_text"))), docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Rows that share an id share its fate.  Empty texts and rows without id are
    alone in their groups and stay.
    """
    firsts = ngram_join.similarity_classes(docs).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    rows = docs.select(common.packed(docs))
    return rows.join(firsts, F.col("row.doc_id").cast("long").eqNullSafe(F.col("first")), "left_semi").select(*common.unpacked(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken, a part of it where a budget ends within it.

    Texts without words are never taken.
    """
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of the mixed documents, by the session's model."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.session_model(spark))


def _counted(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars counts the text as it is now."""
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))
    return df.select(*like.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SentencePiece encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
