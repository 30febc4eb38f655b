"""Queries on the ledger of batches: status, claims, recovery, pruning, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The legal steps between states, failure aside.
STEPS = [
    ("batching", "sealed"), ("sealed", "compressed"), ("compressed", "checksummed"), ("checksummed", "object_uploaded"),
    ("object_uploaded", "manifest_uploaded"), ("manifest_uploaded", "verified"), ("verified", "source_committed"),
    ("failed", "replay_required"), ("replay_required", "batching"), ("verified", "replay_required"),
]


def can_transition(old: Column, new: Column) -> Column:
    """Whether a state may follow another: a listed step, or failure of anything not committed."""
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in STEPS])
    return F.array_contains(steps, F.concat(old, F.lit(">"), new)) | ((new == "failed") & (old != "source_committed"))


def count_by_state(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("state").agg(F.count(F.lit(1)).alias("batches"))


def seed_positions(ledger: DataFrame, source_type: str) -> DataFrame:
    """The farthest committed end of each path."""
    rows = ledger.where((F.col("state") == "source_committed") & (F.col("source_type") == source_type) & F.col("path").isNotNull())
    return rows.groupBy("path").agg(F.max("end_byte").alias("end_byte")).where(F.col("end_byte").isNotNull()).select("path", F.greatest("end_byte", F.lit(0)).alias("end_byte"))


def claimable(ledger: DataFrame, owner: str, now: Column) -> DataFrame:
    free = F.col("owner").isNull() | (F.col("owner") == owner) | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    return ledger.where((F.col("state") != "source_committed") & free)


def recovery_actions(ledger: DataFrame) -> DataFrame:
    action = F.when(F.col("state") == "source_committed", "none").when(F.col("state") == "verified", "retry_commit").otherwise("replay")
    return ledger.select("batch_id", "state", action.alias("action"))


def prunable(ledger: DataFrame, cutoff: Column, limit: int | None = None) -> DataFrame:
    """Committed rows that a later committed row of their source supersedes, older than the cutoff.

    The newest row of each source always stays; ranking replaces a theta self-join.
    """
    key = F.coalesce("path", "source_name")
    newest = W.partitionBy("source_type", key).orderBy(F.coalesce("end_byte", F.lit(-1)).desc(), F.col("updated_at").desc(), F.col("batch_id").desc())
    rows = ledger.where(F.col("state") == "source_committed").withColumn("rank", F.row_number().over(newest))
    rows = rows.where((F.col("rank") > 1) & (F.col("updated_at") < cutoff)).drop("rank")
    return rows if limit is None else rows.orderBy("updated_at", "batch_id").limit(limit)


def work_dir_deletions(files: DataFrame, cap: int, retention: int) -> DataFrame:
    """Files to delete per directory: expired, or the oldest beyond the byte cap."""
    newest_first = W.partitionBy("dir").orderBy(F.col("mtime").desc(), F.col("name").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = files.withColumn("kept", F.sum("bytes").over(newest_first))
    return rows.where((F.col("age") >= retention) | (F.col("kept") > cap)).select("dir", "name", "bytes")


def reconcile(manifests: DataFrame, ledger: DataFrame, objects: DataFrame) -> DataFrame:
    """A verdict for each manifest; a missing ledger row is no failure."""
    m, r, o = manifests.alias("m"), ledger.alias("r"), objects.alias("o")
    rows = m.join(r, F.col("m.batch_id") == F.col("r.batch_id"), "left").join(o, F.col("m.batch_id") == F.col("o.batch_id"), "left")
    verdict = (
        F.when(F.col("o.batch_id").isNull(), "object_missing")
        .when(F.col("o.bytes") != F.col("m.bytes"), "size_differs")
        .when(F.col("o.sha") != F.col("m.sha"), "digest_differs")
        .when(F.col("r.batch_id").isNull(), "ok_without_ledger")
        .when(~F.col("r.state").isin("verified", "source_committed"), "ledger_not_verified")
        .otherwise("ok")
    )
    return rows.select(F.col("m.batch_id").alias("batch_id"), verdict.alias("verdict"))


def format_of(sources: DataFrame, mapping: DataFrame) -> DataFrame:
    """Format by the first mapping of a source's name, else as detected."""
    first = mapping.groupBy("name").agg(F.min_by("format", "position").alias("mapped"))
    return sources.join(first, sources["source_name"] == first["name"], "left").select("source_name", F.coalesce("mapped", "detected").alias("format"))
