"""Tables in the folder that the driver and all executors share: where long plans end and new ones begin."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafgrid-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _path(spark: SparkSession, name: str):
    """A new table's path, as text and for Hadoop; the table goes when the driver ends, as results that are not yet computed may read it until then."""
    path = f"{shared_dir(spark)}/leafgrid/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.deleteOnExit(there)
    return path, lambda: store.delete(there, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of plans that are made and run in here go once the rows are there, not when the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str) -> None:
    """Adds the rows to the table; nothing reads the plan's shuffles afterwards."""
    with brief_shuffles(df.sparkSession):
        df.write.mode("append").parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends, and a lost executor costs only its own tasks."""
    path, _ = _path(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Chain:
    """Tables of which each is read by the next one only: once that is written, the one before is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.drop = spark, lambda: None

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return self.joined([df], name)

    def joined(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """One table of the rows of all parts, written one after the other: only one part's shuffles are on disk at a time."""
        path, drop = _path(self.spark, name)
        for df in parts:
            _write(df, path)
        self.drop()
        self.drop = drop
        return self.spark.read.schema(df.schema).parquet(path)


def in_slices(make: Callable[[Column, Chain], DataFrame], spark: SparkSession, key: str, slices: int, name: str) -> DataFrame:
    """The rows that ``make`` gives for each slice of the keys, one slice after the other, as one table.

    make: takes the test for a slice's rows and a chain for its tables; only one
    slice's tables and shuffles are on disk at a time.
    """
    path, _ = _path(spark, name)
    for i in range(slices):
        chain = Chain(spark)
        made = make(F.pmod(F.xxhash64(key), F.lit(slices)) == i, chain)
        _write(made, path)
        chain.drop()
    return spark.read.schema(made.schema).parquet(path)
