"""Shared plumbing: tables in the shared folder, merged per-task states, connected components."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.tables import Chain, brief_shuffles, materialize, shared_dir  # noqa: F401  the operators' way to them

#: ``[\x20\x09-\x0D]``, the white space of every operator here.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """All columns as one, ``row``: whatever their names, they clash with no column put beside them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``df`` out of ``row``, some of them anew, then those that are added."""
    own = [new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in df.columns]
    return own + [v.alias(k) for k, v in new.items() if k not in df.columns]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; ASCII strings take the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def merged(df: DataFrame, local: Callable[[Iterator[pa.RecordBatch]], np.ndarray], cells: int, dtype: str, how: str = "sum", blocks: int = 64) -> np.ndarray:
    """A fixed-size array merged over all tasks (``sum`` or ``or``).

    Each task folds its rows into one array of ``cells`` entries and sends it in
    compressed blocks; each block is merged by one task.  What reaches the driver
    is the array alone, whose size does not depend on the rows.
    """
    step = -(-cells // blocks)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = local(batches)
        for b in range(blocks):
            part = state[b * step : (b + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "part": pa.array([zlib.compress(part.astype(dtype).tobytes(), 1)], pa.binary())})

    def unite(t: pa.Table) -> pa.Table:  # two rounds: no task merges the blocks of all tasks
        total = None
        for x in t.column("part"):
            part = np.frombuffer(zlib.decompress(x.as_py()), dtype=dtype)
            total = part.copy() if total is None else total + part if how == "sum" else total | part
        return pa.table({"block": t.column("block").slice(0, 1), "part": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    shape = "block int, part binary"
    with brief_shuffles(df.sparkSession):
        parts = df.mapInArrow(fold, shape).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
        rows = parts.groupBy("block", "lane").applyInArrow(unite, shape).groupBy("block").applyInArrow(unite, shape).collect()
    out = np.zeros(cells, dtype=dtype)
    for row in rows:
        part = np.frombuffer(zlib.decompress(bytes(row["part"])), dtype=dtype)
        out[row["block"] * step : row["block"] * step + len(part)] = part
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link; label is the smallest node of its component.

    ``links`` has two columns, a and b.  Alternates the large-star and small-star
    steps until no link changes (labels only fall, so it ends; the rounds grow
    with the logarithm of the longest path); each step is a grouped minimum (partial on the
    map side) and a join, so no neighbourhood is ever gathered.
    """
    edges = materialize(links.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = () if edges.isEmpty() else None
    while mark != ():
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        mark = () if now == mark else now
    pairs = edges.groupBy("a").agg(F.min("b").alias("label"))
    return pairs.union(pairs.select("label", "label").distinct()).toDF("node", "label")
