"""Recovery and verification: stored manifests and objects against the ledger, and reports on segments.

A null where a value is needed counts as missing; empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Digest algorithms that a manifest may declare besides "none", which verifies weakly.
ALGORITHMS = ["sha256", "blake3"]
#: How much a verdict on a segment may rely on, from least to most.
LEVELS = ["self_consistent", "root_pinned", "authenticated"]


def incomplete(ledger: DataFrame, failed_only: bool = False) -> DataFrame:
    """Batches whose source is not committed (or those that failed), oldest first, then by batch_id."""
    rows = ledger.where(F.col("state") == "failed") if failed_only else ledger.where(F.col("state") != "source_committed")
    return rows.orderBy("created_at", "batch_id")


def newest_batches(ledger: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest batches, newest first, ties by batch_id."""
    return ledger.orderBy(F.col("created_at").desc(), "batch_id").limit(most)


def strongly_verified(ledger: DataFrame, strict: bool = True) -> DataFrame:
    """Verified batches; under a ``strict`` policy only those whose backend could check the content."""
    rows = ledger.where(F.col("state") == "verified")
    return rows.where(~F.coalesce("backend_limited", F.lit(False))) if strict else rows


def _content(m: str, o: str) -> Column:
    """passed, limited or failed of manifest against object, and null if the object is missing."""
    declared = F.lower(F.col(f"{m}.algorithm"))
    weak = F.when(declared == "none", F.when(F.coalesce(F.col(f"{m}.digest"), F.lit("")) == "", "limited").otherwise("failed"))
    known = F.coalesce(declared.isin(*ALGORITHMS), F.lit(False)) & (F.coalesce(F.col(f"{m}.digest"), F.lit("")) != "")
    same = F.lower(F.col(f"{m}.digest")) == F.lower(F.col(f"{o}.digest"))
    strong = F.when(known & F.coalesce(same, F.lit(False)), "passed").otherwise("failed")
    return F.when(F.col(f"{o}.uri").isNull(), F.lit(None)).when(F.coalesce(F.col(f"{o}.bytes") != F.col(f"{m}.bytes"), F.lit(True)), "failed").otherwise(F.coalesce(weak, strong))


def verify_manifests(manifests: DataFrame, objects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each current manifest's verdict, passed, limited or failed, with the first reason against it.

    manifests: uri, latest, batch_id, object_uri, authentic, algorithm, digest, bytes;
    objects: uri, bytes, digest; ledger: batch_id, state, object_sha.  No ledger row is no failure.
    """
    rows = manifests.where("latest").alias("m").join(objects.alias("o"), F.col("m.object_uri") == F.col("o.uri"), "left").join(ledger.select("batch_id", "state", "object_sha").alias("l"), F.col("m.batch_id") == F.col("l.batch_id"), "left")
    content = _content("m", "o")
    recorded = F.col("l.object_sha").isNotNull() & (F.coalesce(F.col("m.digest"), F.lit("")) != "")
    reason = (
        F.when(~F.col("m.authentic"), "not_authentic").when(content.isNull(), "object_missing").when(content == "failed", "content_differs")
        .when(F.col("l.batch_id").isNotNull() & ~F.col("l.state").isin("verified", "source_committed"), "ledger_not_verified")
        .when(recorded & (F.lower(F.col("l.object_sha")) != F.lower(F.col("m.digest"))), "ledger_digest_differs")
    )
    return rows.select(F.col("m.uri").alias("uri"), F.when(reason.isNotNull(), "failed").otherwise(content).alias("verdict"), reason.alias("reason"))


def recheck_verified(ledger: DataFrame, manifests: DataFrame, objects: DataFrame, strict: bool = True) -> DataFrame:
    """What recovery does with each verified batch: commit, or replay for the first reason.

    The manifest is read at the ledger's pinned version, else at the current one; then
    it must authenticate and agree with the ledger, and the object with both.  Whatever
    cannot be read counts against the batch.
    """
    m = manifests.alias("m")
    pinned = (F.col("l.manifest_uri") == F.col("m.uri")) & F.when(F.col("l.manifest_version").isNotNull(), F.col("l.manifest_version") == F.col("m.version")).otherwise(F.col("m.latest"))
    rows = ledger.where("state = 'verified'").alias("l").join(m, pinned, "left").join(objects.alias("o"), F.col("m.object_uri") == F.col("o.uri"), "left")
    content = _content("m", "o")
    l = lambda c: F.col(f"l.{c}")  # noqa: E731, E741
    reason = (
        F.when(l("object_uri").isNull() | l("manifest_uri").isNull(), "no_uri").when(F.col("m.uri").isNull(), "manifest_missing").when(~F.col("m.authentic"), "not_authentic")
        .when(F.col("m.batch_id") != l("batch_id"), "wrong_batch").when(F.col("m.object_uri") != l("object_uri"), "uri_differs")
        .when(l("manifest_sha").isNull() | (F.col("m.sha") != l("manifest_sha")), "manifest_differs")
        .when(l("object_bytes").isNotNull() & (l("object_bytes") != F.col("m.bytes")), "size_differs").when(l("object_sha").isNotNull() & (F.col("m.digest") != "") & (F.lower(l("object_sha")) != F.lower(F.col("m.digest"))), "digest_differs")
        .when(content.isNull(), "object_missing").when(content == "failed", "content_differs").when((content == "limited") & F.lit(strict), "weak")
    )
    return rows.select(l("batch_id").alias("batch_id"), F.when(reason.isNull(), "commit").otherwise("replay").alias("action"), reason.alias("reason"))


def recovery_summary(ledger: DataFrame, rechecked: DataFrame) -> DataFrame:
    """One row: batches that recovery commits, replays, and finds committed already."""
    rows = ledger.join(rechecked.select("batch_id", "action"), "batch_id", "left")
    replay = (F.col("state") != "source_committed") & (F.coalesce("action", F.lit("replay")) == "replay")
    return rows.agg(F.count_if(F.col("action") == "commit").alias("commits"), F.count_if(replay).alias("replays"), F.count_if(F.col("state") == "source_committed").alias("settled"))


def segment_report(checks: DataFrame, required: str = LEVELS[0]) -> DataFrame:
    """By segment, from its checks (segment, check, passed; null: not run): whether all pass, the level reached and the first failure by name.

    A keyed statement that passes authenticates; a pinned root or manifest digest that
    passes pins; the required level must be reached too.
    """
    ran = F.col("passed").isNotNull()
    holds = lambda *names: F.coalesce(F.bool_or(F.when(F.col("check").isin(*names), F.col("passed"))), F.lit(False))
    out = checks.groupBy("segment").agg(F.bool_and(F.when(ran, F.col("passed"))).alias("clean"), F.min(F.when(ran & ~F.col("passed"), F.col("check"))).alias("first_failure"), holds("statement-mac").alias("keyed"), holds("root-pin", "manifest-digest-pin").alias("pinned"))
    level = F.when(F.col("keyed"), 2).when(F.col("pinned"), 1).otherwise(0)
    names = F.array(*map(F.lit, LEVELS))
    clean = F.coalesce("clean", F.lit(False))
    return out.select("segment", (clean & (level >= LEVELS.index(required))).alias("verified"), F.when(clean, F.get(names, level)).alias("level"), "first_failure")


def group_commits(requests: DataFrame, most: int = 256, max_records: int = 1024, max_bytes: int = 1 << 20, delay: int = 5) -> DataFrame:
    """The commit group of each produce request of a shard and why that group was flushed.

    requests: shard, position, at (ms, not descending by position), records, bytes.  A
    cycle starts when the last group is out and a request waits; it flushes as soon as the
    waiting ones reach a limit, or after ``delay``.  The group takes requests from the
    front; one that would exceed a limit starts the next group, but is never refused alone.
    A shard's queue is folded by one task in one pass.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        at, records, sizes = (rows[c].tolist() for c in ("at", "records", "bytes"))
        groups, reasons, first, now, group = [], [], 0, None, 0
        while first < len(at):
            start = at[first] if now is None else max(now, at[first])
            end, waiting, count, size, reason = first, 0, 0, 0, None
            now = start
            while reason is None:
                while end < len(at) and at[end] <= now:
                    waiting, count, size, end = waiting + 1, count + records[end], size + sizes[end], end + 1
                if waiting >= most:
                    reason = "max_pending"
                elif count >= max_records:
                    reason = "max_records"
                elif size >= max_bytes:
                    reason = "max_bytes"
                elif end < len(at) and at[end] <= start + delay:
                    now = at[end]
                else:
                    now, reason = start + delay, "single_request" if waiting == 1 else "max_delay"
            taken = taken_bytes = 0
            stop = first
            while stop < end and (stop == first or taken + records[stop] <= max_records and taken_bytes + sizes[stop] <= max_bytes):
                taken, taken_bytes, stop = taken + records[stop], taken_bytes + sizes[stop], stop + 1
                if taken >= max_records or taken_bytes >= max_bytes:
                    break
            groups += [group] * (stop - first)
            reasons += [reason] * (stop - first)
            first, group = stop, group + 1
        return rows[["shard", "position"]].assign(group=groups, reason=reasons)

    return requests.groupBy("shard").applyInPandas(fold, "shard long, position long, group long, reason string")


def group_commit_totals(requests: DataFrame, groups: DataFrame) -> DataFrame:
    """By flush reason: groups, requests, records and bytes."""
    rows = requests.join(groups, ["shard", "position"])
    each = rows.groupBy("shard", "group", "reason").agg(F.count(F.lit(1)).alias("requests"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    return each.groupBy("reason").agg(F.count(F.lit(1)).alias("groups"), *[F.sum(c).alias(c) for c in ("requests", "records", "bytes")])


def follower_appends(requests: DataFrame) -> DataFrame:
    """Whether a follower that stood at ``tip`` takes an append (online, same range, fence, base, count): the first rule that decides.

    requests: id, online, own_range, range_id, own_fence, fence, tip, committed, base, count.
    """
    verdict = (
        F.when(~F.col("online"), "offline").when(F.col("own_range") != F.col("range_id"), "wrong_range").when(F.col("fence") < F.col("own_fence"), "fenced")
        .when((F.col("tip") > F.col("base")) & (F.col("committed") >= F.col("base") + F.col("count")), "already_applied").when(F.col("tip") > F.col("base"), "overlap").when(F.col("tip") < F.col("base"), "gap").otherwise("append")
    )
    return requests.select("id", verdict.alias("verdict"))


def file_commits(commits: DataFrame) -> DataFrame:
    """The read head after each commit of a file's end (path, position, end, inode, own_inode, size) and whether the file may be deleted then.

    A head never moves back; a file goes only if it is the one that was read and wholly so.
    """
    head = F.max("end").over(W.partitionBy("path").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow))
    return commits.select("path", "position", head.alias("head"), F.coalesce((F.col("inode") == F.col("own_inode")) & (F.col("end") >= F.col("size")), F.lit(False)).alias("deletable"))
