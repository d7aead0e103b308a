"""Following a run page by page, and stopping it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession


def each_page(pages: DataFrame, tell: Callable[[object, str | None], None], key: str = "path", order: str = "place") -> int:
    """Calls ``tell(key, error)`` for each page in order and returns how many failed.

    The driver holds one partition's keys and errors at a time, no pixels.
    """
    failed = 0
    for row in pages.select(order, key, "error").orderBy(order).toLocalIterator():
        tell(row[key], row["error"])
        failed += row["error"] is not None
    return failed


class Cancellable(AbstractContextManager):
    """Jobs started inside can be cancelled from another thread; those of others go on."""

    def __init__(self, spark: SparkSession):
        self.context, self.group = spark.sparkContext, f"leafgrid-{uuid.uuid4().hex}"

    def __enter__(self) -> Cancellable:
        self.context.setJobGroup(self.group, "page conversion", interruptOnCancel=True)
        return self

    def __exit__(self, *_: object) -> None:
        self.context.setLocalProperty("spark.jobGroup.id", None)
        self.context.setLocalProperty("spark.job.description", None)

    def cancel(self) -> None:
        self.context.cancelJobGroup(self.group)
