"""Queries of recovery, verification and group commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrill.operators import recovery as V

from .registry import query

_CONTENT = """CASE WHEN o.uri IS NULL THEN NULL WHEN o.bytes <> m.bytes THEN 'failed' WHEN lower(m.algorithm) = 'none' THEN CASE WHEN m.digest = '' THEN 'limited' ELSE 'failed' END
  WHEN lower(m.algorithm) NOT IN ('sha256', 'blake3') OR m.digest = '' THEN 'failed' WHEN lower(m.digest) = lower(o.digest) THEN 'passed' ELSE 'failed' END"""


@query("claims", sql="SELECT batch_id, state, created_at FROM claims WHERE state <> 'source_committed'")
def incomplete_batches(claims):
    return V.incomplete(claims).select("batch_id", "state", "created_at")


@query("claims", sql="SELECT batch_id FROM claims WHERE state = 'verified' AND NOT backend_limited")
def strongly_verified(claims):
    return V.strongly_verified(claims).select("batch_id")


@query("claims", sql="SELECT batch_id, created_at FROM claims ORDER BY created_at DESC, batch_id LIMIT 50")
def newest_batches(claims):
    return V.newest_batches(claims, 50).select("batch_id", "created_at")


@query("manifests", "objects", "claims", sql=f"""WITH r AS (SELECT m.uri, {_CONTENT} AS content, m.authentic, m.digest, l.batch_id, l.state, l.object_sha
    FROM manifests m LEFT JOIN objects o ON m.object_uri = o.uri LEFT JOIN claims l ON m.batch_id = l.batch_id WHERE m.latest),
  v AS (SELECT uri, content, CASE WHEN NOT authentic THEN 'not_authentic' WHEN content IS NULL THEN 'object_missing' WHEN content = 'failed' THEN 'content_differs' WHEN batch_id IS NOT NULL AND state NOT IN ('verified', 'source_committed') THEN 'ledger_not_verified'
    WHEN object_sha IS NOT NULL AND digest <> '' AND lower(object_sha) <> lower(digest) THEN 'ledger_digest_differs' END AS reason FROM r)
SELECT uri, CASE WHEN reason IS NULL THEN content ELSE 'failed' END AS verdict, reason FROM v""")
def manifest_verification(manifests, objects, claims):
    return V.verify_manifests(manifests, objects, claims)


_RECHECK = f"""r AS (SELECT l.batch_id, CASE WHEN l.object_uri IS NULL OR l.manifest_uri IS NULL THEN 'no_uri' WHEN m.uri IS NULL THEN 'manifest_missing' WHEN NOT m.authentic THEN 'not_authentic' WHEN m.batch_id <> l.batch_id THEN 'wrong_batch'
    WHEN m.object_uri <> l.object_uri THEN 'uri_differs' WHEN m.sha <> l.manifest_sha THEN 'manifest_differs' WHEN l.object_bytes <> m.bytes THEN 'size_differs' WHEN m.digest <> '' AND lower(l.object_sha) <> lower(m.digest) THEN 'digest_differs'
    WHEN o.uri IS NULL THEN 'object_missing' WHEN {_CONTENT} = 'failed' THEN 'content_differs' WHEN {_CONTENT} = 'limited' THEN 'weak' END AS reason
  FROM claims l LEFT JOIN manifests m ON l.manifest_uri = m.uri AND (l.manifest_version = m.version OR (l.manifest_version IS NULL AND m.latest)) LEFT JOIN objects o ON m.object_uri = o.uri WHERE l.state = 'verified')"""


@query("claims", "manifests", "objects", sql=f"WITH {_RECHECK} SELECT batch_id, CASE WHEN reason IS NULL THEN 'commit' ELSE 'replay' END AS action, reason FROM r")
def recovery_recheck(claims, manifests, objects):
    return V.recheck_verified(claims, manifests, objects)


@query("claims", "manifests", "objects", sql=f"""WITH {_RECHECK} SELECT (SELECT count(*) FROM r WHERE reason IS NULL) AS commits, (SELECT count(*) FROM claims WHERE state NOT IN ('source_committed', 'verified')) + (SELECT count(*) FROM r WHERE reason IS NOT NULL) AS replays,
  (SELECT count(*) FROM claims WHERE state = 'source_committed') AS settled""")
def recovery_summary(claims, manifests, objects):
    return V.recovery_summary(claims, V.recheck_verified(claims, manifests, objects))


_CHECKS = ("frame-scan", "content-root", "manifest-canonical", "root-pin", "statement-mac")


@query("orders", sql="""WITH c AS (SELECT o_orderkey AS segment, unnest(['frame-scan', 'content-root', 'manifest-canonical', 'root-pin', 'statement-mac']) AS name, unnest([o_orderkey % 11 > 0, o_orderkey % 13 > 0, true,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 17 > 0 END, CASE WHEN o_orderkey % 5 > 1 THEN NULL ELSE o_orderkey % 7 > 0 END]) AS passed FROM orders),
  s AS (SELECT segment, bool_and(passed) AS clean, min(name) FILTER (NOT passed) AS first_failure, coalesce(bool_or(passed) FILTER (name = 'statement-mac'), false) AS keyed, coalesce(bool_or(passed) FILTER (name = 'root-pin'), false) AS pinned FROM c GROUP BY segment)
SELECT segment, clean AND (keyed OR pinned) AS verified, CASE WHEN NOT clean THEN NULL WHEN keyed THEN 'authenticated' WHEN pinned THEN 'root_pinned' ELSE 'self_consistent' END AS level, first_failure FROM s""")
def segment_reports(orders):
    k = F.col("o_orderkey")
    passed = (k % 11 > 0, k % 13 > 0, F.lit(True), F.when(k % 3 != 0, k % 17 > 0), F.when(k % 5 <= 1, k % 7 > 0))
    checks = orders.select(k.alias("segment"), F.explode(F.array(*[F.struct(F.lit(c).alias("check"), p.alias("passed")) for c, p in zip(_CHECKS, passed)])).alias("c")).select("segment", "c.*")
    return V.segment_report(checks, "root_pinned")


@query("records")
def group_commits(records):
    requests = records.select(F.col("unit").alias("shard"), "position", F.expr("position div 7 * 4").alias("at"), (F.col("bytes") % 5 + 1).alias("records"), "bytes")
    return V.group_commit_totals(requests, V.group_commits(requests, 6, 12, 40, 100))


@query("records", sql="""SELECT position AS id, CASE WHEN position % 23 = 0 THEN 'offline' WHEN range_id % 7 <> unit % 7 THEN 'wrong_range' WHEN epoch < producer % 3 THEN 'fenced' WHEN position % 90 > position % 70 AND position % 80 >= position % 70 + sequence % 6 THEN 'already_applied'
  WHEN position % 90 > position % 70 THEN 'overlap' WHEN position % 90 < position % 70 THEN 'gap' ELSE 'append' END AS verdict FROM records""")
def follower_appends(records):
    p = F.col("position")
    return V.follower_appends(records.select(p.alias("id"), (p % 23 != 0).alias("online"), (F.col("range_id") % 7).alias("own_range"), (F.col("unit") % 7).alias("range_id"), (F.col("producer") % 3).alias("own_fence"), F.col("epoch").alias("fence"), (p % 90).alias("tip"), (p % 80).alias("committed"), (p % 70).alias("base"), (F.col("sequence") % 6).alias("count")))


@query("records", sql="""SELECT topic || unit AS path, position, max(position * 37 % 1009) OVER (PARTITION BY topic, unit ORDER BY position) AS head, position % 3 = epoch AND position * 37 % 1009 >= 500 AS deletable FROM records""")
def file_commits(records):
    p = F.col("position")
    return V.file_commits(records.select(F.concat("topic", F.col("unit").cast("string")).alias("path"), "position", (p * 37 % 1009).alias("end"), (p % 3).alias("inode"), F.col("epoch").alias("own_inode"), F.lit(500).alias("size")))
