"""Incremental ingest: a stream over an image folder that only takes pages whose stored result is stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafgrid.operators import pages
from leafgrid.settings import Settings

_FILES = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New image files of a folder as they come."""
    return pages.images_only(spark.readStream.format("binaryFile").schema(_FILES).load(folder))


def recognise_stream(files: DataFrame, settings: Settings, status_path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on each batch's stale files and appends its (path, error) to the status table, with key and rotation.

    A batch that is retried finds its pages done: they are stale no more.
    """
    key = settings.ocr_key()

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        entries = batch.withColumns({"ocr_key": F.lit(key), "rotation": F.lit(0)})
        try:
            entries = pages.stale(entries, spark.read.parquet(status_path))
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise  # only the first batch has no status yet
        done = work(entries).select("path", "error")
        done.select("path", F.lit(key).alias("ocr_key"), F.lit(0).alias("rotation"), F.col("error").isNotNull().alias("failed"), "error").write.mode("append").parquet(status_path)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
