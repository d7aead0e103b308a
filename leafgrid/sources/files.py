"""File sources: images, phrase lists, place trees, truth files; and text and page sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.functions import text as X
from leafgrid.operators import pages
from leafgrid.raster import kernels as K
from leafgrid.raster.resample import capped


def image_files(spark: SparkSession, inputs: Sequence[str]) -> DataFrame:
    """(place, path) of the images in folders (not their sub-folders) and among files, in the order given, folders in natural order.

    Unknown suffixes and missing paths are left out.  Only paths are read, no content.
    """
    found = []
    for i, at in enumerate(inputs):
        try:
            listed = spark.read.format("binaryFile").load(at).select("path")
            found.append(pages.images_only(listed).withColumn("arg", F.lit(i)))
        except Exception as problem:  # a missing path is no page
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    if not found:
        return spark.createDataFrame([], "place long, path string")
    every = reduce(DataFrame.union, found)
    return pages.in_natural_order(every, first=["arg"]).select("place", "path")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, mode, data) of the images that Spark's own reader decodes, rows of BGR pixels; others have mode -1 if they are dropped."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")


def exif_orientation(data: bytes) -> int:
    """How a JPEG's pixels are to be turned (1 to 8, 1: not at all), from its EXIF segment."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            first = int.from_bytes(tiff[4:8], order)
            for i in range(int.from_bytes(tiff[first : first + 2], order)):
                entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
                if int.from_bytes(entry[:2], order) == 0x0112:
                    value = int.from_bytes(entry[8:10], order)
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def image_pages(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """(path, height, width, channels, data) as a viewer shows the images: turned as EXIF says, transparency on white, BGR.

    ``longest`` caps the longest side, for thumbnails.  Turns come from a pass
    over the files' heads and travel as a number for each path.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([exif_orientation(d) for d in b.column("head").to_pylist()], pa.int32())], names=["path", "turn"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                img = K.opaque(K.upright(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]), r["turn"] or 1))
                img = capped(img, longest)[0] if longest else img
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "height": pa.array([img.shape[0]], pa.int32()), "width": pa.array([img.shape[1]], pa.int32()), "channels": pa.array([3], pa.int32()), "data": pa.array([np.ascontiguousarray(img).tobytes()], pa.binary())})

    turns = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 1 << 18).alias("head")).mapInArrow(heads, "path string, turn int").where("turn <> 1")
    name = F.regexp_replace("path", "^file:/+", "/")
    both = image_pixels(spark, path).withColumn("at", name).join(turns.select(name.alias("at"), "turn"), "at", "left")
    return both.select("path", "height", "width", "channels", "data", "turn").mapInArrow(show, "path string, height int, width int, channels int, data binary")


def phrase_lines(spark: SparkSession, path: str) -> DataFrame:
    """(phrase) of a list: comments and blank lines go, syllables are canonical and joined by single spaces."""
    lines = spark.read.text(path).where("trim(value) <> '' and value not like '#%'")
    syllables = F.transform(X.tokens(X.nfc(F.col("value"))), X.canonical)
    return lines.select(F.array_join(syllables, " ").alias("phrase")).distinct()


def place_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Places, and those with a spaced dash also without its spaces."""
    base = phrase_lines(spark, path).withColumnRenamed("phrase", "place")
    return base.union(base.where(F.contains("place", F.lit(" - "))).select(F.replace("place", F.lit(" - "), F.lit("-")))).distinct()


def lexicon_tables(spark: SparkSession, general: str, domain: Sequence[str] = (), user: str | None = None) -> DataFrame:
    """(phrase, domain) of a general list and domain lists; a user's own list is the domain's too."""
    marked = [phrase_lines(spark, general).withColumn("domain", F.lit(False))]
    marked += [phrase_lines(spark, p).withColumn("domain", F.lit(True)) for p in [*domain, *([user] if user else [])]]
    return reduce(DataFrame.union, marked).groupBy("phrase").agg(F.bool_or("domain").alias("domain"))


PLACE_TREE = "data array<struct<name:string, level2s:array<struct<name:string, level3s:array<struct<name:string>>>>>>"


def place_names(spark: SparkSession, path: str, prefixes: Sequence[str]) -> DataFrame:
    """(name) of a three-level JSON tree: lower case, also without an administrative prefix unless a number remains; two syllables at least, sorted."""
    tree = spark.read.schema(PLACE_TREE).json(path, multiLine=True).select(F.explode("data").alias("a"))
    second = tree.select(F.explode("a.level2s").alias("b"))
    third = second.select(F.explode("b.level3s").alias("c"))
    raw = tree.select("a.name").union(second.select("b.name")).union(third.select("c.name"))
    name = F.array_join(X.tokens(F.lower(X.nfc(F.col("name")))), " ")
    full = raw.select(name.alias("name"))
    bare: Column = F.lit(None).cast("string")
    for p in reversed(list(prefixes)):  # the first that fits counts
        bare = F.when(F.col("name").startswith(p + " "), F.substring("name", len(p) + 2, 2**31 - 1)).otherwise(bare)
    both = full.union(full.select(bare.alias("name")).where("name is not null and not name rlike '^[0-9]+$'"))
    return both.where(F.size(F.split("name", " ")) >= 2).distinct().orderBy("name")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(text, bold): arrays of a page's true lines and of the bold ones."""
    return spark.read.schema("text array<string>, bold array<string>").json(path, multiLine=True)


Recognise = Callable[[bytes, int, int], str]


def recognised(images: DataFrame, engine: Recognise, key: str = "path") -> DataFrame:
    """(key, hocr, error) from a pluggable engine: a function from pixels, height and width to hOCR; a failing page is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    rows.append((r["key"], engine(r["data"], r["height"], r["width"]), None))
                except Exception as problem:  # whatever an engine raises is the page's, not the job's
                    rows.append((r["key"], None, f"{type(problem).__name__}: {problem}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["key", "hocr", "error"])

    return images.select(F.col(key).alias("key"), "data", "height", "width").mapInArrow(run, "key string, hocr string, error string").withColumnRenamed("key", key)


def write_text(pages_text: DataFrame, path: str, order: str = "page_no") -> None:
    """One text: pages in order, an empty line and a form feed between them, a line break at the end.

    A file has one writer; it streams the sorted pages.
    """
    first = pages_text.agg(F.min(order)).first()[0]
    value = F.when(F.col(order) == first, F.col("text")).otherwise(F.concat(F.lit("\n\f"), "text"))
    pages_text.orderBy(order).select(value.alias("value")).coalesce(1).write.text(path)


def write_names(names: DataFrame, path: str, header: str) -> None:
    """A comment line, then the sorted names."""
    head = names.sparkSession.createDataFrame([(f"# {header}",)], "value string").withColumn("k", F.lit(0))
    head.union(names.select(F.col("name").alias("value"), F.lit(1).alias("k"))).orderBy("k", "value").select("value").coalesce(1).write.text(path)
