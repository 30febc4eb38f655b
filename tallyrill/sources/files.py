"""Byte-exact scans of files and spools, and the topics that a scan takes.

Files are read by Spark's own readers, so any file system will do.  A record is
bytes: no decoding, and only the line feed separates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "source string, start_byte long, end_byte long, value binary"


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """Regular files that match a glob: path, length, modified. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(pattern)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def whole_files(spark: SparkSession, pattern: str, max_bytes: int) -> DataFrame:
    """Each file as one verbatim record; empty files give none, files over ``max_bytes`` raise."""
    files = spark.read.format("binaryFile").load(pattern).where("length > 0")
    over = F.raise_error(F.concat(F.lit("file over the byte budget: "), "path"))
    content = F.when(F.col("length") > max_bytes, over.cast("binary")).otherwise(F.col("content"))
    return files.select(F.col("path").alias("source"), F.lit(0).cast("long").alias("start_byte"), F.col("length").alias("end_byte"), content.alias("value"))


def lines(spark: SparkSession, pattern: str, starts: DataFrame | None = None) -> DataFrame:
    """Complete lines of each file with their byte range, the line feed included in the range only.

    ``starts`` (source, start_byte) says where reading goes on; other files begin at
    0.  A tail without line feed is no record yet; carriage returns are kept.  A file
    is one task's work: Spark's text reader splits files but also ends lines at
    carriage returns, so ``split_lines`` reads large files instead.
    """
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("source"), "content")
    if starts is None:
        files = files.withColumn("start_byte", F.lit(0).cast("long"))
    else:
        files = files.join(starts.select("source", "start_byte"), "source", "left").withColumn("start_byte", F.coalesce("start_byte", F.lit(0).cast("long")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content, start in zip(*(batch.column(c) for c in ("source", "content", "start_byte"))):
                data, at = content.as_py(), start.as_py()
                while at < len(data):
                    begins, ends, values = [], [], []
                    while len(values) < 10_000 and (stop := data.find(b"\n", at)) >= 0:
                        begins.append(at)
                        ends.append(stop + 1)
                        values.append(data[at:stop])
                        at = stop + 1
                    if not values:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(values)), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(values, pa.binary())], ["source", "start_byte", "end_byte", "value"])

    return files.mapInArrow(cut, _FIELDS)


def split_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(source, value) of text lines, large files cut over many tasks.

    A tail without line feed counts as a line here, and bytes that are not UTF-8 are replaced.
    """
    rows = spark.read.option("lineSep", "\n").text(pattern)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.encode("value", "UTF-8").alias("value"))


def identities(spark: SparkSession, pattern: str) -> DataFrame:
    """What tells one file from another under the same name: size and time of change."""
    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select(F.col("path").alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def resume(positions: DataFrame, committed: DataFrame) -> DataFrame:
    """Where each source goes on: the farther of its start and the committed end, unless the file is shorter or another."""
    c = committed.select("source", F.col("end_byte").alias("done"), F.col("identity").alias("was"))
    rows = positions.join(c, "source", "left")
    same = F.col("was").isNull() | (F.col("was") == F.col("identity"))
    at = F.greatest("start_byte", F.coalesce("done", F.lit(0)))
    return rows.select("source", F.when(same & (at <= F.col("size")), at).otherwise(F.lit(0)).alias("start_byte"))


def topics(names: DataFrame, include: str, exclude: str | None = None) -> DataFrame:
    """Topics in which ``include`` is found and ``exclude`` is not."""
    rows = names.where(F.col("topic").rlike(include))
    return rows if exclude is None else rows.where(~F.col("topic").rlike(exclude))


def kafka(spark: SparkSession, servers: str, include: str, max_records: int) -> DataFrame:
    """A stream of topics; needs Spark's Kafka connector on the class path. Offsets are never committed by the reader."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribePattern", include)
    rows = reader.option("maxOffsetsPerTrigger", max_records).option("startingOffsets", "earliest").load()
    return rows.select("topic", "partition", "offset", "key", "value")
