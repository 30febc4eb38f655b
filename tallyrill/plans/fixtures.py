"""Ledger, log and metric tables derived from the driver's tables, in SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each as a query over the driver's tables, which stand in braces.
SQL = {
    "ledger": """
SELECT o_orderkey AS batch_id, 't' || CAST(o_custkey % 7 AS STRING) AS tenant, CASE WHEN o_orderkey % 3 = 0 THEN 'kafka' ELSE 'file' END AS source_type,
  's' || CAST(o_custkey % 40 AS STRING) AS source_name, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '/logs/' || CAST(o_custkey % 40 AS STRING) END AS path,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'verified' WHEN o_orderkey % 13 = 0 THEN 'sealed' ELSE 'source_committed' END AS state,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 37 % 100000 END AS end_byte,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'A' ELSE 'B' END AS owner,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 2000 + o_orderkey % 100 END AS lease_expires_at,
  o_orderkey % 9973 AS updated_at, o_custkey * 100 AS bytes FROM {orders}""",
    "records": """
SELECT event_id AS position, user_id % 20 AS range_id, event_type AS topic, CAST(length(props) AS BIGINT) AS bytes,
  user_id % 5 AS producer, event_id % 3 AS epoch, event_id % 50 AS sequence, user_id % 12 AS unit FROM {events}""",
    "marks": "SELECT user_id % 20 AS range_id, max(event_id) % 977 AS high_watermark, count(*) AS committed FROM {events} GROUP BY user_id % 20",
    "epochs": "SELECT DISTINCT user_id % 20 AS range_id, event_id % 6 AS epoch, (event_id % 6) * 9 AS start_offset FROM {events}",
    # three rows of an order are a segment's replicas, the next three those of a further segment (an order has far fewer than 1,000,003 rows)
    "replicas": """
SELECT l_orderkey * 1000003 + place - (place - 1) % 3 AS segment, (place - 1) % 3 + 1 AS node, (place - 1) % 3 = 0 AS leader, 3 AS replication, "offset"
FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS INTEGER) AS place,
  CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_suppkey * 10 END AS "offset" FROM {lineitem}) AS placed""",
    "samples": """
SELECT event_id AS id, event_type AS series, ts, CAST(event_id % 400 AS DOUBLE) AS value FROM {events}""",
    "nodes": """
SELECT p_partkey AS segment, s_suppkey AS node, s_nationkey AS domain, (p_partkey * 7919 + s_suppkey * 104729) % 1000003 AS score
FROM {part} CROSS JOIN {supplier}""",
    "counters": """
SELECT event_id AS id, event_type AS series, 'k' || CAST(user_id % 4 AS STRING) AS kind, ts, CAST(event_id % 400 AS DOUBLE) AS value FROM {events}""",
    "gauges": """
SELECT s_suppkey AS node, 'shard' || CAST(s_nationkey AS STRING) AS shard, s_suppkey % 9 > 0 AS running, s_suppkey % 5 - 1 AS role, s_suppkey * 13 % 101 - 1 AS last_log, s_suppkey * 7 % 97 - 1 AS committed, s_suppkey % 4 AS followers, s_suppkey % 6 = 0 AS fenced
FROM {supplier}""",
    "claims": """
SELECT o_orderkey AS batch_id, CASE o_orderkey % 7 WHEN 0 THEN 'source_committed' WHEN 1 THEN 'sealed' WHEN 2 THEN 'failed' ELSE 'verified' END AS state, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'o/' || CAST(o_orderkey AS STRING) END AS object_uri,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'm/' || CAST(o_orderkey AS STRING) END AS manifest_uri, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END AS manifest_version,
  'h' || CAST(o_orderkey % 7 AS STRING) AS manifest_sha, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey * 100 END AS object_bytes, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'd' || CAST(o_orderkey % 10 AS STRING) END AS object_sha,
  o_orderkey % 11 = 0 AS backend_limited, o_custkey AS created_at FROM {orders} WHERE o_orderkey % 59 > 0""",
    "manifests": """
SELECT o_orderkey + CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END AS batch_id, 'm/' || CAST(o_orderkey AS STRING) AS uri, (o_orderkey + CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END) % 3 AS version, o_orderkey % 4 > 0 OR o_orderkey % 5 > 0 AS latest,
  'o/' || CAST(o_orderkey + CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS STRING) AS object_uri, 'h' || CAST((o_orderkey + CASE WHEN o_orderkey % 67 = 0 THEN 1 ELSE 0 END) % 7 AS STRING) AS sha, o_orderkey % 71 > 0 AS authentic,
  CASE o_orderkey % 9 WHEN 0 THEN 'none' WHEN 1 THEN 'crc' ELSE 'sha256' END AS algorithm, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'D' || CAST(o_orderkey % 10 AS STRING) END AS digest, o_custkey * 100 AS bytes FROM {orders} WHERE o_orderkey % 17 > 0""",
    "objects": """
SELECT 'o/' || CAST(o_orderkey AS STRING) AS uri, o_custkey * 100 + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS bytes, 'd' || CAST((o_orderkey + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END) % 10 AS STRING) AS digest FROM {orders} WHERE o_orderkey % 19 > 0""",
    "pieces": """
SELECT o_orderkey AS segment, o_custkey % 300 AS range_id, o_orderkey % 17 * 40 AS base, o_orderkey % 17 * 40 + 30 + o_custkey % 12 AS next, o_custkey % 5 AS slot, o_orderkey % 400 AS name, o_orderkey % 19 = 0 AS active FROM {orders}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or one of the driver's tables."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SQL[name].replace('"offset"', "`offset`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "events", "lineitem", "part", "supplier") if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with the fixtures that it names as common table expressions."""
    named = [f"{n} AS ({q.replace('{', '').replace('}', '')})" for n, q in SQL.items() if f" {n}" in sql.replace("\n", " ")]
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH" and named:
        recursive = rest.startswith("RECURSIVE ")
        return f"WITH {'RECURSIVE ' * recursive}{', '.join(named)}, {rest.removeprefix('RECURSIVE ')}"
    return f"WITH {', '.join(named)} {sql}" if named else sql.strip()
