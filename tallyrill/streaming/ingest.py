"""Streams of records into stored, verified batches, and running counters.

A micro-batch is cut into batches by source; executors store and verify each, and
only the ledger rows return, to be written as a table.  A batch's name follows from
its source and range, so a micro-batch that runs again after a failure replaces its
objects by equal ones, and its ledger rows by equal rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrill.sources.objects import Backend, store_batch

LEDGER = "batch_id string, source string, start long, end long, state string, records long, raw_bytes long, object_bytes long, object_sha256 string, manifest_sha256 string"


def store_batches(records: DataFrame, backend: Callable[[], Backend], most: int = 10_000, slice_rows: int = 100_000) -> DataFrame:
    """Ledger rows of ``records`` (source, position, value), stored and verified.

    A source is first cut at multiples of ``slice_rows`` positions, so one hot source
    is the work of many tasks and none holds more than a slice.
    """

    def store(rows: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        rows = rows.sort_values("position")
        out = []
        for at in range(0, len(rows), most):
            part = rows.iloc[at : at + most]
            source, start, end = part["source"].iloc[0], int(part["position"].iloc[0]), int(part["position"].iloc[-1])
            name = f"{hashlib.sha256(str(source).encode()).hexdigest()[:16]}-{start:020d}-{end:020d}"
            row = store_batch(backend(), name, [bytes(v) for v in part["value"]], {"source": source, "start": start, "end": end})
            out.append(row | {"source": source, "start": start, "end": end})
        return pd.DataFrame(out)[[f.split()[0] for f in LEDGER.split(", ")]]

    cut = records.where(F.col("value").isNotNull()).withColumn("slice", F.floor(F.col("position") / slice_rows))
    return cut.groupBy("source", "slice").applyInPandas(store, LEDGER)


def ingest(stream: DataFrame, backend: Callable[[], Backend], ledger: str, checkpoint: str, most: int = 10_000) -> StreamingQuery:
    """Take all that a stream holds now, then stop. Progress moves only after every batch is verified."""

    def each(rows: DataFrame, number: int) -> None:
        # one folder a micro-batch: a repeated run overwrites its own rows
        path = f"{ledger}/micro_batch={number}"
        store_batches(rows, backend, most).write.mode("overwrite").parquet(path)
        bad = rows.sparkSession.read.schema(LEDGER).parquet(path).where("state <> 'verified'").limit(1).count()
        if bad:
            raise RuntimeError(f"micro-batch {number} has a batch that could not be verified; its progress is not committed")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Finished spool files as they appear, a record a file: (source, position, value)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    return files.where("length > 0").select(F.col("path").alias("source"), F.lit(0).cast("long").alias("position"), F.col("content").alias("value"))


def counts_by_window(stream: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Records per second by tumbling window of event time ``ts``; state is dropped once rows can come too late only."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n", (F.col("n") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("rate"))


def appended(stream: DataFrame) -> DataFrame:
    """The answer to each append of an idempotent producer, with state per (producer, epoch).

    stream: producer, epoch, sequence, code, position.  Sequences below the window of
    65,536 are refused, which bounds the state.
    """
    window = 65_536

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (-1, "")
        codes = {int(a): int(b) for a, b in (x.split(":") for x in seen.split(",") if x)}
        rows = pd.concat(list(frames)).sort_values("position")
        answers = []
        for sequence, code in zip(rows["sequence"], rows["code"]):
            if sequence in codes:
                answer = "duplicate" if codes[sequence] == code else "conflict"
            elif sequence <= last - window:
                answer = "below_window"
            elif sequence != last + 1:
                answer = "gap"
            else:
                answer, last = "append", int(sequence)
                codes[last] = int(code)
                codes.pop(last - window, None)
            answers.append(answer)
        state.update((last, ",".join(f"{a}:{b}" for a, b in codes.items())))
        yield pd.DataFrame({"producer": key[0], "epoch": key[1], "position": rows["position"].values, "answer": answers})

    return stream.groupBy("producer", "epoch").applyInPandasWithState(fold, "producer long, epoch long, position long, answer string", "last long, seen string", "append", "NoTimeout")
